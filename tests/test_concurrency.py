import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsmill.operators.perf import max_concurrent
from newsmill.sources import batches, concurrency

SCHEMA = "g string, start_ts timestamp, stop_ts timestamp, bucket int"
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def intervals(spark, seed, first, days, n=300):
    """Intervals that cross buckets and days, stay open, are empty, or share instants."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = first * 86400 + rng.randrange(days * 86400) // 7 * 7
        took = rng.choice([0, 5, 60, 600, 5000, 100000])
        stop = None if rng.random() < 0.05 else ZERO + datetime.timedelta(seconds=a + took)
        start = None if rng.random() < 0.03 else ZERO + datetime.timedelta(seconds=a)
        out.append((rng.choice(["a", "a", "b", None]), start, stop, 1))
    return spark.createDataFrame(out, SCHEMA)


def peaks_of(df):
    return {r.g: r.max_concurrent for r in df.collect()}


def brute_days(df):
    found = {}
    for g in ("a", "b", None):
        changes = {}
        for r in df.collect():
            if r.g == g and r.start_ts:
                for t, d in ((r.start_ts, 1), (r.stop_ts, -1)):
                    if t:
                        changes[t] = changes.get(t, 0) + d
        open_, last = 0, None
        for t in sorted(changes):
            day = t.date()
            if day != last:
                found[g, day] = (open_, max(open_, 0))
                last = day
            open_ += changes[t]
            found[g, day] = (found[g, day][0], max(found[g, day][1], open_))
    return found


def test_batches_in_any_order_equal_the_sweep(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(ValueError):
        concurrency.peaks(spark, path)
    parts = [intervals(spark, 1, 2, 2), intervals(spark, 2, 0, 3), intervals(spark, 3, 1, 1, 0), intervals(spark, 4, 3, 1)]
    whole = None
    for k, df in enumerate(parts):
        concurrency.add(df, path, f"b{k}", ["g"])
        whole = df if whole is None else whole.unionByName(df)
        assert peaks_of(concurrency.peaks(spark, path)) == peaks_of(max_concurrent(whole, ["g"]))
    days = {(r.g, r.day): (r.opening, r.max_concurrent) for r in concurrency.by_day(spark, path).collect()}
    assert days == brute_days(whole)
    # the same batch with other rows takes the place of the old one
    concurrency.add(intervals(spark, 9, 5, 1, 40), path, "b1", ["g"])
    left = parts[0].unionByName(parts[3]).unionByName(intervals(spark, 9, 5, 1, 40))
    assert peaks_of(concurrency.peaks(spark, path)) == peaks_of(max_concurrent(left, ["g"]))


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    concurrency.add(intervals(spark, 5, 0, 4), path, 0, ["g"])
    day = intervals(spark, 6, 9, 1, 50).where("stop_ts IS NULL OR stop_ts < '2024-01-11'")
    concurrency.add(day, path, 1, ["g"])
    late = {"1": batches.committed(path)["1"]}
    pairs = batches.read(spark, path, late, "pairs", f"{late['1']['types']}day int, bucket long, total long, top long")
    edges = day.where("start_ts IS NOT NULL").select("g", F.explode(F.array("start_ts", "stop_ts")).alias("t")).where("t IS NOT NULL")
    assert pairs.count() == edges.select("g", F.floor(F.unix_seconds("t") / 60)).distinct().count()


def test_without_groups_and_a_killed_batch(spark, tmp_path):
    path = str(tmp_path / "c")
    df = intervals(spark, 7, 0, 2)
    concurrency.add(df, path, 0)
    folder = batches.new_folder(path)
    df.select(F.lit(1).alias("d")).write.parquet(f"{folder}/points")  # and no commit
    assert concurrency.peaks(spark, path).first()[0] == max_concurrent(df).first()[0]
    with pytest.raises(ValueError):
        concurrency.add(df, path, 1, bucket_seconds=7)
