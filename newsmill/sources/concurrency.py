"""Open intervals over time, kept so that a batch touches only its own time buckets.

A bucket is kept as a pair (total, top): the sum of its changes and the largest sum of its
first changes. Pairs of neighbouring buckets merge into the pair of both, (a + b,
max(top a, a + top b)), so peaks of any length of time come from pairs alone. Inside a
bucket changes of several batches interleave, so their instants are kept too, in folders
by day; a batch reads those of the buckets it touches and publishes their new pairs. The
newest pair of a bucket counts.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions.frames import join_on
from newsmill.operators.perf import instants
from newsmill.sources import batches

DAY_MICROS = 86400 * 1000000
EARLIER = (W.unboundedPreceding, -1)


def _types(df, by):
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in by)


def _day(t="t"):
    return F.floor(F.col(t) / F.lit(DAY_MICROS)).cast("int").alias("day")


def _points(spark, path, commits, types, days=None):
    """Instants of some commits; of some days only, if named."""
    names = [f"{path}/{c['folder']}/points/day={d}" for c in commits.values() for d in c["days"] if days is None or d in days]
    schema = f"{types}t long, d long, bucket long"
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return rows.select("*", _day())


def pairs_of(points, by):
    """(total, top) of each bucket from its instants."""
    summed = points.groupBy(*by, "day", "bucket", "t").agg(F.sum("d").alias("d"))
    upto = F.sum("d").over(W.partitionBy(*by, "day", "bucket").orderBy("t"))
    return summed.withColumn("upto", upto).groupBy(*by, "day", "bucket").agg(F.sum("d").alias("total"), F.max("upto").alias("top"))


def add(df, path, batch, by=(), start="start_ts", stop="stop_ts", bucket_seconds=60):
    """Publish a batch of intervals, half open; without a stop they stay open, without a
    start they are left out. A batch under a published name replaces that one. One writer
    at a time."""
    spark, by = df.sparkSession, list(by)
    if 86400 % bucket_seconds:
        raise ValueError("a day must be a whole number of buckets")
    types, folder = _types(df, by), batches.new_folder(path)
    points = instants(df, by, start, stop, bucket_seconds).select("*", _day())
    points.repartitionByRange("day", "bucket").write.partitionBy("day").parquet(f"{folder}/points")
    written = spark.read.schema(f"{types}t long, d long, bucket long, day int").parquet(f"{folder}/points")
    own = {"folder": folder.removeprefix(f"{path}/"), "days": sorted(r.day for r in written.select("day").distinct().collect())}
    new = _points(spark, path, {"": own}, types)

    every, others = batches.committed(path), batches.committed(path, without=batch)
    replaced = {k: c for k, c in every.items() if k not in others}
    keys = [*by, "day", "bucket"]
    touched = new.select(*keys).unionByName(_points(spark, path, replaced, types).select(*keys)).distinct()
    days = {*own["days"], *(d for c in replaced.values() for d in c["days"])}
    old = join_on(_points(spark, path, others, types, days), touched, keys, "left_semi")
    pairs = pairs_of(new.unionByName(old), by)
    # a bucket that only the replaced batch had is empty now
    join_on(touched, pairs, keys, "left").na.fill(0, ["total", "top"]).write.parquet(f"{folder}/pairs")
    seq = 1 + max((c["seq"] for c in every.values()), default=-1)
    batches.commit(path, batch, folder, by=by, types=types, seq=seq, days=own["days"])


def _running(rows, by, order):
    """Each pair with what is open before it."""
    before = F.sum("total").over(W.partitionBy(*by).orderBy(order).rowsBetween(*EARLIER))
    return rows.withColumn("opening", F.coalesce(before, F.lit(0)))


def by_day(spark, path):
    """Per group and day with a change: how many are open when it begins, and its peak."""
    commits = batches.committed(path)
    if not commits:
        raise ValueError(f"no batch was published in {path}")
    fact = next(iter(commits.values()))
    by, schema = fact["by"], f"{fact['types']}day int, bucket long, total long, top long"
    pairs = None
    for c in commits.values():
        part = batches.read(spark, path, {"": c}, "pairs", schema).withColumn("seq", F.lit(c["seq"]))
        pairs = part if pairs is None else pairs.unionByName(part)
    newest = pairs.groupBy(*by, "day", "bucket").agg(F.max_by(F.struct("total", "top"), "seq").alias("p")).select(*by, "day", "bucket", "p.*")
    days = _running(newest, [*by, "day"], "bucket").groupBy(*by, "day").agg(F.sum("total").alias("total"), F.max(F.col("opening") + F.col("top")).alias("top"))
    peak = F.greatest(F.col("opening"), F.col("opening") + F.col("top"), F.lit(0))
    return _running(days, by, "day").select(*by, F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), "opening", peak.alias("max_concurrent"))


def peaks(spark, path):
    """Per group: the largest number of intervals open at once."""
    days = by_day(spark, path)
    by = [c for c in days.columns if c not in ("day", "opening", "max_concurrent")]
    return days.groupBy(*by).agg(F.max("max_concurrent").alias("max_concurrent"))
