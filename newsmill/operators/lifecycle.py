"""Object versions: current version, retention, grouping by type."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import join_on
from newsmill.functions.text import col


def next_in_order(df, keys, ts, tie, bucket_days=1):
    """Adds ``next_ts``: the time of the following row of the same key.

    Rows are ordered inside (key, time bucket); only the first time of each bucket
    is carried across buckets. A key with a very long history is therefore
    sorted in many tasks, not one.
    """
    keys = list(keys)
    bucket = F.floor(F.unix_seconds(col(ts).cast("timestamp")) / F.lit(86400 * bucket_days)).cast("long")
    rows = df.withColumn("_b", bucket)
    within = W.partitionBy(*keys, "_b").orderBy(ts, tie)
    across = W.partitionBy(*keys).orderBy("_b")
    edges = rows.groupBy(*keys, "_b").agg(F.min(ts).alias("_first"))
    edges = edges.select(*keys, "_b", F.lead("_first").over(across).alias("_after"))
    ordered = rows.withColumn("_next", F.lead(ts).over(within))
    return join_on(ordered, edges, [*keys, "_b"]).withColumn("next_ts", F.coalesce("_next", "_after")).drop("_b", "_next", "_after")


def retention_plan(df, as_of, key="key", version="version", ts="modified_ts"):
    """Adds ``is_current``, ``next_ts`` and ``action``: a current version older than
    30 days expires; a noncurrent one is deleted 7 days after it was replaced."""
    return plan_actions(next_in_order(df, [key], ts, version), as_of, ts)


def plan_actions(rows, as_of, ts="modified_ts"):
    """``is_current`` and ``action`` of versions that know their ``next_ts``."""
    now = F.lit(as_of).cast("timestamp")
    age = lambda t: (F.unix_micros(now) - F.unix_micros(t.cast("timestamp"))) / F.lit(86400.0 * 1e6)
    current = F.col("next_ts").isNull()
    action = (
        F.when(current & (age(col(ts)) > dims.RETENTION_DAYS), "expire")
        .when(~current & (age(F.col("next_ts")) > dims.NONCURRENT_DAYS), "delete")
        .otherwise("keep")
    )
    return rows.withColumn("is_current", current).withColumn("action", action)


def latest_version(df, key="key", order=("modified_ts", "version")):
    """Current version per key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def type_rollup(df, type="type", item=("name",)):
    """Items listed under their type, with the type's size, in report order.

    The listing stays in rows: a type with very many items is range-sorted over
    several tasks instead of being collected into one array.
    """
    sizes = df.groupBy(type).agg(F.count(F.lit(1)).alias("n_in_type"))
    return join_on(df.select(type, *item), sizes, [type]).orderBy(type, *item)
