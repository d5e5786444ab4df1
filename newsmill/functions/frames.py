"""DataFrame helpers shared by the operators."""

from functools import reduce

from pyspark.sql import functions as F


def explode_rows(df, keep, array, pos=False):
    """One row per array element as ``r`` (and ``pos``); none for an empty array.

    The outer form is used because for the plain one the optimizer adds a check
    of the array's size below, which computes a costly array twice.
    """
    if pos:
        return df.select(*keep, F.posexplode_outer(array).alias("pos", "r")).where("r IS NOT NULL")
    return df.select(*keep, F.explode_outer(array).alias("r")).where("r IS NOT NULL")


def join_on(left, right, keys, how="inner"):
    """Equi-join on same-named keys in which a null key meets a null key, so the
    group without a name is not lost. Other columns must not share names. Without
    keys ``right`` is the single row of an aggregate, and only then sent to all."""
    if not keys:  # one key for all rows, from a column so that it is not folded away
        one = lambda df: df.withColumn("_all", F.pmod(F.hash(df.columns[0]), F.lit(1)))
        return join_on(one(left), F.broadcast(one(right)), ["_all"], how).drop("_all")
    other = lambda k: f"_other_{k}"
    renamed = right.select(*[F.col(k).alias(other(k)) for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(other(k))) for k in keys])
    return left.join(renamed, same, how).drop(*[other(k) for k in keys])


def spread(df):
    """The rows dealt evenly over a few tasks for each core, for costly work on rows whose
    file has few splits. Dealt in turn, not by a key, so repeated keys do not gather."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)
