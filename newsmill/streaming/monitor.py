"""Executions followed through overlapping polls, with state that ends with them."""

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from newsmill.operators.perf import distinct_executions, execution_monitor
from newsmill.session import run_dir
from newsmill.streaming.jobs import land_batches

LOOK_BACK_SECONDS = 10
RUNNING = "RUNNING"
# buckets of the state: 10 million executions are some 2,500 in each
BUCKETS = 4096


@contextmanager
def setting(spark, key, value):
    """A setting of the session for the streams started inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def newest_of_batches(polls, id, order):
    """Of each id, the newest row of every Arrow batch: what is combined before the
    shuffle, so an id polled very often brings few rows to its task."""
    where, at = polls.columns.index(id), polls.columns.index(order)

    def run(batches):
        for batch in batches:
            ids = batch.column(where).dictionary_encode(null_encoding="encode")
            codes, newest = ids.indices.to_numpy(), np.zeros(len(ids.dictionary), np.int64)
            by_order = pc.sort_indices(batch.column(at)).to_numpy().astype(np.int64)
            newest[codes[by_order]] = by_order  # of one id the last stays
            yield batch.take(pa.array(np.sort(newest)))

    return polls.mapInArrow(run, polls.schema)


def text_of_integers(df):
    """Whole numbers as text, and the way back: pandas would turn a column of them with
    nulls into doubles."""
    whole = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    back = lambda out: out.select(*[F.col(c).cast(whole[c]) if c in whole else F.col(c) for c in out.columns])
    return df.select(*[F.col(c).cast("string") if c in whole else F.col(c) for c in df.columns]), back


def followed(held, ids, ats, finals, now, look_back):
    """Notes polled rows, one per id, in ``held``, {id: (last state seen, when it may be
    dropped in ms, 0 while it runs)}, and says which rows bring news."""
    news = []
    for i, at, final in zip(ids, ats, finals):
        seen, until = held.get(i, (None, 0))
        news.append(seen is None or at > seen)
        if not news[-1]:
            at, final = seen, until > 0
        held[i] = (at, now + max(1, int(look_back * 1000)) if final else 0)
    return news


def execution_changes(polls, id="execution_id", status="status", order="seq", look_back=LOOK_BACK_SECONDS, buckets=BUCKETS):
    """The rows of a stream of polls that bring news: an execution seen for the first time,
    or in a later state than before.

    State is the last state seen of each execution and whether it is final. A running execution stays; one
    in a final state is dropped by a timer after the look-back, when polls no longer return
    it. Polls may overlap, repeat and come in any order. A row that comes back after its
    state is gone passes again, so totals are taken over the newest row of each id.

    State lies in buckets of ids. A batch is one call of Python for each bucket it meets,
    not for each execution, and writes the state of these buckets anew. ``buckets`` is
    fixed for a checkpoint.
    """
    columns = polls.columns

    def step(key, frames, state):
        now, best = state.getCurrentProcessingTimeMs(), None
        held = {i: (at, until) for i, at, until in zip(*state.get)} if state.exists else {}
        met = set()
        if not state.hasTimedOut:
            for frame in frames:
                rows = frame if best is None else pd.concat([best, frame], ignore_index=True)
                best = rows.sort_values("_at", ascending=False, kind="stable").drop_duplicates("_id")
            met = set(best["_id"])
            news = followed(held, best["_id"].tolist(), best["_at"].tolist(), (best[status] != RUNNING).tolist(), now, look_back)
            if any(news):
                yield best.loc[news, columns]
        held = {i: h for i, h in held.items() if i in met or not 0 < h[1] <= now}
        if held:
            ends = [until for _, until in held.values() if until]
            state.update((list(held), *map(list, zip(*held.values()))))
            if ends:  # set anew at each call: a timer does not outlive one
                state.setTimeoutDuration(max(1, min(ends) - now))
        elif state.exists:
            state.remove()

    newest, back = text_of_integers(newest_of_batches(polls, id, order))
    schema, at = newest.schema, F.col(order).cast("long")
    newest = newest.withColumn("_id", F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit("")))
    newest = newest.withColumn("_at", F.coalesce(at, F.lit(-(2**63))))
    newest = newest.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)))
    held = "ids array<string>, seen array<long>, until array<long>"
    return back(newest.groupBy("_bucket").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.ProcessingTimeTimeout))


def stream_execution_monitor(polls, since, by, out=None, id="execution_id", look_back=LOOK_BACK_SECONDS):
    """``execution_monitor`` over a stream of polls: each batch lands the executions that
    changed, and totals are taken over the newest row of each.

    Rows of runs that began more than the look-back before ``since`` are not followed.
    """
    recent = polls.where(F.col("start_ts") >= F.lit(since).cast("timestamp") - F.expr(f"INTERVAL {LOOK_BACK_SECONDS} SECONDS"))
    changes = execution_changes(recent, id, look_back=look_back)
    newest = lambda rows: distinct_executions(rows, id).select(*polls.columns)
    # with processing-time timers Spark runs empty batches for ever, and an available-now
    # run would not end; timers are looked at in each batch that has polls
    with setting(polls.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        landed = land_batches(changes, out or run_dir(polls.sparkSession, "monitor"), "monitor", newest)
    return execution_monitor(landed, since, by, id)
