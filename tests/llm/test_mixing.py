import random
import re
from collections import Counter

from newsmill.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not full:
            return {**out, **share}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)


def check(got, rows):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(sizes), Counter()
    assert sorted(map(repr, ((r.doc_id, r.size, r.source_size) for r in got))) == sorted(repr((i, size(t), sizes[s])) for i, t, s in rows)
    source = {i: s for i, _, s in rows}
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    longest = {s: max(size(t) for _, t, x in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s], (s, taken[s], want[s])


def test_targets_and_copies(table):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])) if i % 50 else None, rnd.choice(["a", "b", "b", "b", "b", "b", "é", "z", None])) for i in range(1500)]
    rows += [(9001, " \n", "empty"), (9002, None, "empty"), (9003, "x\x0by\x85z", "one")]
    got = M.mix_report(table(rows, schema=SCHEMA)).collect()
    check(got, rows)
    again = M.mix_report(table(rows, parts=7, schema=SCHEMA)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(M.mix_report(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_empty_and_repeated(table):
    assert M.mix_report(table([], schema=SCHEMA)).count() == 0
    got = M.mix_report(table([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)], schema=SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in got) == [(0, 0), (1, 2), (1, 2)]


def test_splitting_tree_keeps_quotas(spark):
    units = [("a", 300), ("b", 7), (None, 40), ("c", 1)]
    df = spark.createDataFrame(units, "source string, quota long")
    got = M.shard_quotas(df, 8).collect()
    total, per = Counter(), Counter()
    for r in got:
        total[r.source] += r.quota
        per[r.shard] += r.quota
    assert dict(total) == dict(units) and len(per) == 8
    assert max(per.values()) - min(per.values()) <= 3
    a = [r.quota for r in got if r.source == "a"]
    assert len(set(a)) > 1  # drawn, not dealt evenly


def test_mix_rows_follow_the_report(table, tmp_path, spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 30), rnd.choice("aab")) for i in range(600)]
    df = table(rows, schema=SCHEMA)
    out = M.mixed(df, shards=4).collect()
    count = Counter(r.doc_id for r in out)
    for r in M.mix_report(df).collect():
        assert r.size == 0 or count[r.doc_id] * r.size == r.taken
    assert len({(r.doc_id, r["_copy"]) for r in out}) == len(out)
    assert {r["_shard"] for r in out} == {0, 1, 2, 3}
    M.mix_files(df, str(tmp_path / "mix"), shards=4)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == len(out)


def test_report_and_stage_take_what_the_shards_hold(table, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 30), rnd.choice("aab")) for i in range(600)]
    df = table(rows, schema=SCHEMA)
    placed = sorted(M.mixed(df).collect(), key=lambda r: (r["_shard"], r["_turn"]))
    want = [r.doc_id for r in placed if r.text]
    assert [r.doc_id for r in M.draw(df).collect() if r.text] == want != sorted(want)
    assert sorted(r.doc_id for r in M.draw(df).collect() if not r.text) == [i for i, t, _ in rows if not t]
    whole, tree = M.shard_quotas, {}
    monkeypatch.setattr(M, "shard_quotas", lambda *a: whole(*a).where("shard < 15"))  # the last shard is lost
    for r in placed:
        if r["_shard"] < 15:
            tree[r.doc_id] = tree.get(r.doc_id, 0) + words_in(r.text)
    assert {r.doc_id: r.taken for r in M.mix_report(df).collect() if r.taken} == {i: n for i, n in tree.items() if n}
    assert sorted(r.doc_id for r in M.draw(df).collect() if r.text) == sorted(r.doc_id for r in placed if r.text and r["_shard"] < 15)


def words_in(text):
    return len(WORD.findall(text))
