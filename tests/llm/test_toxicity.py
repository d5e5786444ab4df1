import zlib

import numpy as np

from newsmill.llm import toxicity as T


def rates(rows, labels):
    got = {r.doc_id: r for r in rows}
    held = [(got[i], y) for i, y in labels.items() if i in got and got[i].held_out]
    hit = sum(r.predicted for r, y in held if y) / max(1, sum(y for _, y in held))
    false = sum(r.predicted for r, y in held if not y) / max(1, sum(1 - y for _, y in held))
    return hit, false, held


def fitted(rows, labels):
    ends = np.cumsum([0, *map(len, rows)])
    return T.fit(np.array([t for r in rows for t in r], np.int32), ends, labels)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    english = {r.doc_id for r in docs.where("lang = 'en'").select("doc_id").collect()}
    known = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    hit, false, _ = rates(rows, {i: y for i, y in known.items() if i in english})
    print("english", hit, false, "all", rates(rows, known)[:2])
    assert hit > 0.8 and false < 0.01
    assert rates(rows, known)[1] < 0.02


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([1] * a + [2] * b + list(set(rng.integers(10, 40, 5).tolist())))
        labels.append(int(a and b))
    m = fitted(rows, labels)
    s = m.scores(np.array([1, 2, 1, 2]), np.array([0, 1, 2, 2]), 4)
    assert s[2] > 0.8 and s[0] < 0.3 and s[1] < 0.3 and s[3] < 0.3


def test_scores_are_the_plain_sum_over_pairs():
    rng = np.random.default_rng(2)
    buckets = np.unique(rng.integers(0, 500, 80))
    m = T.Machine(buckets, -0.3, rng.normal(size=len(buckets)), rng.normal(0, 0.3, (len(buckets), T.RANK)))
    rows = [np.unique(rng.integers(0, 500, rng.integers(0, 40))) for _ in range(50)]
    want = []
    for r in rows:
        at = [int(np.flatnonzero(buckets == b)[0]) for b in r if b in buckets]
        z = m.bias + sum(m.w[a] for a in at) + sum(m.v[a] @ m.v[b] for k, a in enumerate(at) for b in at[:k])
        want.append(1 / (1 + np.exp(-z)))
    got = m.scores(np.concatenate(rows), np.repeat(np.arange(50), [len(r) for r in rows]), 50)
    assert np.allclose(got, want)


def test_sample_is_bounded_in_terms(spark):
    """Rows after the one that reaches the bound are not learned from."""
    import pyarrow as pa

    lists = [list(range(i, i + 50)) for i in range(0, 3000, 30)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(10)], pa.int32()), pa.array(lists[i : i + 10], pa.list_(pa.int32()))], names=["label", "terms"]) for i in range(0, 100, 10)]
    used = lambda most: max(b.column("bucket").to_numpy().max() for b in T.fit_sample(most)(iter(batches)))
    assert used(10**9) == 3019 and used(501) == lists[10][-1] and used(500) == lists[9][-1]


def test_edges(table):
    rows = [(i, ("you idiot " if i % 3 == 0 else "a fine day ") + "word " * (i % 7)) for i in range(300)]
    docs = table(rows + [(900, None), (901, ""), (None, "idiot"), (5, "other row of id 5")])
    labels = table([(i, 1 if i % 3 == 0 else 0) for i in range(300)] + [(None, 1), (3, None)], schema="doc_id long, toxic int")
    got = T.score_toxicity(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 304 and by[900].score == by[901].score < 0.5
    assert by[None].predicted == 1 and by[None].held_out is None
    assert by[3].predicted == 1 and by[4].predicted == 0
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("text LIKE '%idiot%'").count() == 0 and kept.where("text LIKE '%fine%'").count() == 200
    nothing = table([], schema="doc_id long, toxic int")
    assert {r.predicted for r in T.score_toxicity(docs, nothing).collect()} == {0}
    assert T.score_toxicity(table([]), labels).count() == 0


def test_recall_of_each_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = T.score_toxicity(docs, labels).collect()
    for x in sorted(set(lang.values())):
        hit, false, _ = rates(rows, {i: y for i, y in known.items() if lang.get(i) == x})
        print(x, hit, false)
        assert hit > 0.8 and false < 0.02, x


def test_rare_terms_are_learned():
    rng = np.random.default_rng(0)
    noise = lambda: list(set(rng.integers(100, 300, 8).tolist()))
    # a tenth is toxic, told by one of 40 terms of 5 rows each
    rows = [[i // 10 % 40] * (i % 10 == 0) + noise() for i in range(2000)]
    m = fitted(rows, [int(i % 10 == 0) for i in range(2000)])
    assert len(m.buckets) == len({b for r in rows for b in r})
    median = {}
    for toxic in (True, False):
        new = [[i % 40] * toxic + noise() for i in range(200)]
        median[toxic] = np.median(m.scores(np.concatenate(new), np.repeat(np.arange(200), [len(r) for r in new]), 200))
    assert median[True] > 3 * median[False]
