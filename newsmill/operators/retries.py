"""Retry plans and what an attempt log amounts to."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.text import col, lookup


def _delays(retries, base, factor, cap):
    """Planned waits base * factor^i for i < retries, each at most cap."""
    steps = F.when(retries > 0, F.sequence(F.lit(0), retries - 1)).otherwise(F.array().cast("array<int>"))
    wait = lambda i: base * F.pow(factor, i.cast("double"))
    return F.transform(steps, lambda i: F.when(cap.isNull(), wait(i)).otherwise(F.least(wait(i), cap)))


def retry_schedule(df, retries="retries", base="base", factor="factor", cap="cap"):
    """Adds ``delays`` and ``total_wait`` from policy columns (null cap: none)."""
    delays = _delays(col(retries).cast("int"), col(base), col(factor), col(cap))
    return df.withColumn("delays", delays).withColumn(
        "total_wait", F.aggregate("delays", F.lit(0.0), lambda a, d: a + d)
    )


def with_policy(df, policy="policy"):
    """Adds the preset's retries, base, factor and cap as literals by name."""
    table = {p[0]: p[1:] for p in dims.RETRY_POLICIES}
    capped = {k: v for k, v in table.items() if v[3] is not None}
    out = df
    for pos, name in enumerate(["retries", "base", "factor"]):
        out = out.withColumn(name, lookup(policy, table, pos))
    return out.withColumn("cap", lookup(policy, capped, 3).cast("double"))


def retry_outcome(df, request="request_id", order=("ts", "seq"), error_type="error_type",
                  retries=3, base=1.0, factor=2.0, cap=60.0):
    """Per request: final status, attempts used, seconds waited.

    A null error is success. A fatal error stops at once; a retryable one is
    tried again up to ``retries`` times; any other is tried again only after the
    first attempt. Later rows of the log are ignored.

    Only the first retries + 1 rows of a request can matter, and the rank limit
    is applied per task before the shuffle, so a request with a huge log costs
    a few rows.
    """
    w = W.partitionBy(request).orderBy(*order)
    heads = df.select(request, *order, error_type).withColumn("n", F.row_number().over(w)).where(F.col("n") <= retries + 1)
    e = col(error_type)
    stops = (
        e.isNull() | e.isin(dims.FATAL_TYPES) | (~e.isin(dims.RETRYABLE_TYPES) & (F.col("n") > 1)) | (F.col("n") > retries)
    )
    marks = heads.withColumn("stops", stops)
    out = marks.groupBy(request).agg(
        F.min(F.when(F.col("stops"), F.struct("n", col(error_type).alias("e")))).alias("stop"),
        F.max(F.struct("n", col(error_type).alias("e"))).alias("last"),
    )
    end = F.coalesce("stop", "last")
    waits = _delays((F.col("attempts") - 1).cast("int"), F.lit(base), F.lit(factor), F.lit(cap))
    return (
        out.select(
            request,
            F.when(F.col("stop").isNull(), "pending").when(end["e"].isNull(), "success").otherwise("failed").alias("status"),
            end["n"].alias("attempts"), end["e"].alias("last_error"),
        )
        .withColumn("waited", F.aggregate(waits, F.lit(0.0), lambda a, d: a + d))
    )
