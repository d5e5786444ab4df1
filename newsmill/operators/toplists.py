"""Exact most frequent items of very many groups, with bounded memory in every task.

A task keeps for each group at most ``2 * counters`` items with counts that are too low by
``lost`` at most (a mergeable heavy-hitter summary: when it is full, all counts fall by the
first one beyond ``counters``, and what is left at nothing goes). Summaries of tasks add
up. They only propose: an item can be left out where even its count plus all that was lost
stays below the k-th proven count. What remains is counted exactly. Where an item that no
summary holds could still be among the first k, all items of that group are counted.
"""

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions.frames import join_on
from newsmill.session import run_dir, ship_package

# counters of a group in a task, and of all its groups before it hands on what it has
COUNTERS, HELD = 1000, 1 << 20
SUMMARY = "_g binary, _i binary, _low long, _lost long"


class Summary:
    """Counts of one group that are too low by ``lost`` at most."""

    def __init__(self, counters):
        self.counters, self.low, self.lost = counters, {}, 0

    def add(self, item, n):
        self.low[item] = self.low.get(item, 0) + n
        if len(self.low) > 2 * self.counters:
            cut = sorted(self.low.values(), reverse=True)[self.counters]
            self.low = {k: v - cut for k, v in self.low.items() if v > cut}
            self.lost += cut


def summarize(counters, held):
    """Arrow batches of (group, item) -> rows of summaries; a row without an item holds
    what its summary has lost."""

    def flushed(groups):
        rows = [(g, i, n, 0) for g, s in groups.items() for i, n in s.low.items()]
        rows += [(g, None, 0, s.lost) for g, s in groups.items() if s.lost]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_g", "_i", "_low", "_lost"])

    def run(parts):
        groups, size = {}, 0
        for part in parts:
            counted = pa.Table.from_batches([part]).group_by(["_g", "_i"]).aggregate([([], "count_all")])
            for g, i, n in zip(counted["_g"].to_pylist(), counted["_i"].to_pylist(), counted["count_all"].to_pylist()):
                s = groups.get(g)
                if s is None:
                    s = groups[g] = Summary(counters)
                was = len(s.low)
                s.add(i, n)
                size += len(s.low) - was
                if size > held:
                    yield flushed(groups)
                    groups, size = {}, 0
        if groups:
            yield flushed(groups)

    return run


def _digest(columns):
    """128 bits of some columns' values, nulls included."""
    return F.unhex(F.md5(F.to_json(F.struct(F.lit(0).alias("_"), *columns))))


def top_items(df, by, item, k, counters=COUNTERS, held=HELD):
    """Per group of ``by`` its ``k`` most frequent values of ``item`` columns: group, item,
    ``n`` and ``rank`` from 1; ties in order of the item. Nulls are values like others.
    The summaries are written to the shared folder when this is called."""
    by, item = list(by), list(item)
    ship_package(df.sparkSession)
    rows = df.select(*by, *item, _digest(by).alias("_g"), _digest(item).alias("_i"))
    parts = rows.select("_g", "_i").mapInArrow(summarize(counters, held), SUMMARY)
    path = run_dir(df.sparkSession, "top-items")  # a table, so that the pass runs once
    parts.groupBy("_g", "_i").agg(F.sum("_low").alias("_low"), F.sum("_lost").alias("_lost")).write.parquet(path)
    summed = df.sparkSession.read.schema(SUMMARY).parquet(path)
    lost = summed.where("_i IS NULL").select("_g", "_lost")
    proposed = summed.where("_i IS NOT NULL").select("_g", "_i", "_low")
    ranked = proposed.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy(F.desc("_low"))))
    kth = ranked.where(F.col("_r") <= k).groupBy("_g").agg(F.min(F.when(F.col("_r") == k, F.col("_low"))).alias("_kth"))
    state = kth.join(lost, "_g", "left").select("_g", F.coalesce("_kth", F.lit(0)).alias("_kth"), F.coalesce("_lost", F.lit(0)).alias("_lost"))
    # an item without a counter has been seen _lost times at most
    closed = (F.col("_lost") == 0) | (F.col("_kth") > F.col("_lost"))
    kept = proposed.join(state.where(closed), "_g").where(F.col("_low") + F.col("_lost") >= F.col("_kth")).select("_g", "_i")
    wide = state.where(~closed).select("_g")

    counts = lambda part: part.groupBy(*by, *item).agg(F.count(F.lit(1)).alias("n"))
    exact = counts(rows.join(kept, ["_g", "_i"], "left_semi")).unionByName(counts(rows.join(wide, "_g", "left_semi")))
    order = W.partitionBy(*by).orderBy(F.desc("n"), *item)
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
