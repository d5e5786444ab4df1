import random

import pytest
from pyspark.sql import functions as F

from newsmill.operators.quantiles import exact_quantiles, pick_ranks
from newsmill.sources import batches, history

POINTS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
SCHEMA = "ts timestamp, g string, extra int, x double"


def rows(spark, seed, days, n=4000):
    """A hot group, a hot value, ties, a null group, missing and infinite values."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        g = rng.choice(["a", "a", "a", "b", None])
        x = rng.choice([7.0, 7.0, rng.gauss(0, 10), float(rng.randrange(40)), None, float("inf"), -0.0])
        out.append((f"2024-01-{rng.choice(days):02d} 10:00:00", g, 1, x))
    df = spark.createDataFrame(out, "ts string, g string, extra int, x double")
    return df.withColumn("ts", F.to_timestamp("ts"))


def plain(df, by=("g",)):
    ordered = {}
    for r in df.where("x IS NOT NULL AND ts IS NOT NULL").collect():
        ordered.setdefault(tuple(r[c] for c in by), []).append(r.x)
    out = {}
    for k, v in ordered.items():
        v.sort()
        at = []
        for q in POINTS.values():
            p = (len(v) - 1) * q
            lo, f = int(p), p - int(p)
            at.append(v[lo] if not f or v[lo] == v[lo + 1] else v[lo] + (v[lo + 1] - v[lo]) * f)
        out[k] = at
    return out


def result(df, by=("g",)):
    return {tuple(r[c] for c in by): [r[k] for k in POINTS] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], nan_ok=True), k


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("history"))
    days = {b: rows(spark, b, range(1 + 3 * b, 4 + 3 * b)).where("x IS NULL OR x < 1e300") for b in range(3)}
    for b, df in days.items():
        history.add(df, path, b, ["g"], "x", rows_per_file=15)
    return path, days[0].unionByName(days[1]).unionByName(days[2])


def test_any_span(spark, stored):
    path, df = stored
    for first, last in ((None, None), ("2024-01-02", "2024-01-08"), ("2024-01-09", "2024-01-10"), ("2024-01-04", None)):
        inside = df.where((F.col("ts") >= F.lit(first or "2000-01-01")) & (F.col("ts") < F.lit(last or "2100-01-01")))
        same(result(history.stored_quantiles(spark, path, POINTS, first, last)), plain(inside))


def test_few_files_are_read(spark, stored):
    path, _ = stored
    span = history.Span(spark, path)
    total = span.table("blocks", "file string").select("file").distinct().count()
    read = span.files(history.pinned(span.bounds({"p50": 0.5}))).count()
    assert total > 100 and read < total / 3


def test_a_missed_rank_is_looked_up_again(spark, stored, monkeypatch):
    """With cuts that lie on the wrong side of every rank the answer is the same."""
    path, df = stored
    right = history.Span.bounds

    def wrong(self, quantiles):
        far = right(self, quantiles)
        return far.withColumn("low", F.lit(1e9)).withColumn("high", F.lit(2e9))

    monkeypatch.setattr(history.Span, "bounds", wrong)
    same(result(history.stored_quantiles(spark, path, POINTS)), plain(df))


def test_a_batch_replaces_itself_and_a_killed_one_is_not_there(spark, tmp_path):
    path = str(tmp_path / "h")
    first, second = rows(spark, 5, [1, 2], 500), rows(spark, 6, [2, 3], 500)
    history.add(first, path, "one", ["g"], "x")
    history.add(rows(spark, 7, [2], 300), path, "two", ["g"], "x")
    history.add(second, path, "two", ["g"], "x")
    folder = batches.new_folder(path)
    first.write.parquet(f"{folder}/values")  # and no commit
    assert list(batches.committed(path)) == ["one", "two"]
    got, want = result(history.stored_quantiles(spark, path, {"p50": 0.5, **POINTS})), plain(first.unionByName(second))
    same(got, want)


def test_without_groups_and_without_rows(spark, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(ValueError):
        history.stored_quantiles(spark, path, POINTS)
    history.add(spark.createDataFrame([], SCHEMA), path, 0, [], "x")
    assert result(history.stored_quantiles(spark, path, POINTS), ()) == {(): [None] * 5}  # as without a store
    df = rows(spark, 9, [1, 2], 700).where("x IS NULL OR x < 1e300")
    history.add(df, path, 1, [], "x", rows_per_file=50)
    same(result(history.stored_quantiles(spark, path, POINTS), ()), plain(df, ()))


def test_parts_of_a_slice(spark):
    """A whole group as one slice, with hot values, through the second narrowing."""
    df = rows(spark, 11, [1], 5000).where("x < 1e300")
    counted = df.groupBy("g", F.col("x").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(n, counted.g.eqNullSafe(n.g)).drop(n.g).withColumns({"_b": F.lit(0), "_before": F.lit(0)})
    got = pick_ranks(counted, ["g"], {k: (F.col("n") - 1) * q for k, q in POINTS.items()})
    same(result(got), plain(df))
    for parts in (1, 7):
        same(result(exact_quantiles(df, ["g"], "x", POINTS, parts)), plain(df))
