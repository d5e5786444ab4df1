"""Each stage against a plain version of its operator on the stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from newsmill.llm.mixing import mix_report
from newsmill.llm.toxicity import score_toxicity

from test_near_dedup import brute as components
from test_packing import check as check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHING = ["key", "spans", "root", "d0", "d1", *(f"_{c}" for c in "key one size source block part copy copies placed shard turn place spans target".split())]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage; ties, repeats and nulls added to the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = max((r.text for r in docs.collect()), key=len)
    extra = [(900001, long, "en", "src1", len(long)), (900001, long, "en", "src1", len(long)), (900002, long + " x", None, None, None),
             (900003, None, None, None, None), (900004, "", "en", "src1", 0), (None, "no id here", None, None, None),
             (900005, "own words " + long[:600], "en", "src2", 610)]
    frame, out = docs.unionByName(spark.createDataFrame(extra, docs.schema)), []
    frame = frame.withColumns({c: F.concat(F.lit(c), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        result = stage(spark, frame, SF)
        result.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, frame, after))
        frame = after
    return {name: (before, after) for name, before, after in out}


def test_columns_with_clashing_names_are_kept(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns, name
        wrong = [F.col(c) != F.concat(F.lit(c), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING]
        assert after.where(F.greatest(*wrong)).count() == 0, name


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns(steps):
    for name, (_, after) in steps.items():
        assert name == "best_fit_packing" or after.columns == COLUMNS + CLASHING


def test_toxic_documents_go(spark, steps):
    before, after = steps["toxicity"]
    kept = Counter(r.doc_id for r in score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if not r.predicted)
    assert Counter(r[0] for r in rows(after)) == kept and set(rows(after)) <= set(rows(before))
    assert 0 < after.count() <= before.count()


def test_one_document_of_each_group_stays(steps):
    before, after = steps["near_dedup"]
    given = rows(before)
    kept = {i for i, n, c, keep in components([(r[0], r[1]) for r in given]) if keep or n == 0}
    assert Counter(r[0] for r in rows(after) if r[0] is not None) == Counter(i for i in kept if i is not None)
    assert set(rows(after)) <= set(given)


def test_repeated_strings_go(steps):
    before, after = steps["suffix_array_dedup"]
    given, got = rows(before), rows(after)
    seen = Counter(b[k : k + 200] for b in ((r[1] or "").encode() for r in given) for k in range(len(b) - 199))

    def rest(text):
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        at, out = 0, []
        for c in text:
            n = len(c.encode())
            out.append("" if any(gone[at : at + n]) else c)
            at += n
        return "".join(out)

    want = []
    for i, text, lang, source, n in given:
        new = None if text is None else rest(text)
        want.append((i, new, lang, source, n if new == text else len(new)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_mix_takes_copies(steps):
    before, after = steps["source_mixing"]
    taken = Counter(r[0] for r in rows(after))
    for r in mix_report(before).collect():
        assert taken[r.doc_id] == (r.taken // r.size if r.size else 1), r
    assert set(rows(after)) <= set(rows(before))


def test_packing_holds_the_mix(steps):
    before, after = steps["best_fit_packing"]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
