import datetime
import random

from pyspark.sql import functions as F

from newsmill.operators import lifecycle
from newsmill.sources import batches, versions

SCHEMA = "key string, version long, modified_ts timestamp, extra int"
AS_OF = "2024-03-01 00:00:00"


def frame(spark, seed, keys, n):
    rng = random.Random(seed)
    day = lambda: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(days=rng.randrange(60))
    rows = [(rng.choice(keys), seed * 10**6 + i, day(), 1) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def planned(df):
    return sorted((r.key or "", r.version, r.is_current, str(r.next_ts), r.action) for r in df.collect())


def test_three_batches_equal_the_batch_operator(spark, tmp_path):
    """New keys, known keys with later and earlier versions, a null key, repeated rows."""
    path = str(tmp_path / "v")
    keys = [f"k{i}" for i in range(300)] + [None]
    parts = [frame(spark, 1, keys[:200], 600), frame(spark, 2, keys[150:], 300), frame(spark, 3, keys, 50)]
    whole = None
    for k, df in enumerate(parts):
        df = df.unionByName(df.limit(1))
        versions.add(df, path, k, rows_per_file=20)
        whole = df if whole is None else whole.unionByName(df)
        assert planned(versions.plan(spark, path, AS_OF)) == planned(lifecycle.retention_plan(whole, AS_OF))
    assert versions.add(parts[0], path, 0) == 0  # applied once
    want = sorted((r.key or "", r.version) for r in lifecycle.latest_version(whole.drop("extra")).collect())
    got = sorted({(r.key or "", r.version) for r in versions.latest(spark, path).collect()})
    assert got == want


def test_only_files_with_its_keys_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "v")
    known = [f"k{i}" for i in range(2000)]
    rows = [(k, i, datetime.datetime(2024, 1, 1), 1) for i, k in enumerate(known)]
    versions.add(spark.createDataFrame(rows, SCHEMA), path, 0, rows_per_file=50)
    store = versions.Store(spark, path)
    total = store.files().count()
    asked = spark.createDataFrame([("k7",), ("k1234",)], "key string").select(F.xxhash64("key").alias("h"))
    names = {r.file for r in store.holding(asked).collect()}
    hold = {f for f in (r.file for r in store.files().collect()) if store.rows([f]).where("key IN ('k7', 'k1234')").count()}
    assert total >= 40 and hold <= names and len(names) <= 4
    # keys that nobody has met fall into the ranges, and the filters turn them away
    strange = spark.range(300).select(F.xxhash64(F.concat(F.lit("new"), "id")).alias("h"))
    turned = [len({r.file for r in store.holding(strange.where(F.col("h") == r.h)).collect()}) for r in strange.limit(8).collect()]
    assert sum(turned) <= 2
    later = spark.createDataFrame([("k7", 10**6, datetime.datetime(2024, 2, 1), 1)], SCHEMA)
    assert versions.add(later, path, 1, rows_per_file=50) <= 2
    assert versions.latest(spark, path).where("key = 'k7'").first().version == 10**6
    assert versions.latest(spark, path).count() == 2000


def test_filters_miss_no_key(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.range(20000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("version"), F.lit("2024-01-01").cast("timestamp").alias("modified_ts"))
    versions.add(df, path, 0, rows_per_file=9000)
    store = versions.Store(spark, path)
    assert store.files().agg(F.max("blocks")).first()[0] >= 2
    tried = store.rows([r.file for r in store.files().collect()]).select("h").distinct()
    files = store.files()
    met = tried.crossJoin(F.broadcast(files)).where("h >= low AND h <= high").select("file", "h", versions._block(F.col("h"), "blocks").alias("block"))
    hits = met.join(store._table("filters", "file string, block long, bitmap binary"), ["file", "block"]).where(F.forall(versions._bits(F.col("h")), lambda b: versions._set(F.col("bitmap"), b)))
    assert hits.select("h").distinct().count() == 20000


def test_empty_and_killed(spark, tmp_path):
    path = str(tmp_path / "v")
    empty = spark.createDataFrame([], SCHEMA)
    assert versions.add(empty, path, "none") == 0
    assert versions.latest(spark, path).count() == 0
    folder = batches.new_folder(path)
    empty.write.parquet(f"{folder}/rows")  # and no commit
    versions.add(frame(spark, 4, ["a", "b"], 9), path, "some")
    assert versions.latest(spark, path).count() == 2
