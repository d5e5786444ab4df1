import random
from datetime import datetime, timedelta

import pytest

from newsmill.operators.perf import execution_monitor
from newsmill.streaming import jobs, monitor

SCHEMA = "execution_id long, test string, start_ts timestamp, seq int, status string, stop_ts timestamp"
T0 = datetime(2024, 1, 1)


def states(n):
    out = []
    for i in range(n):
        start = T0 + timedelta(seconds=i)
        out.append((i, f"t{i % 3}", start, 1, "RUNNING", None))
        if i % 4:
            out.append((i, f"t{i % 3}", start, 2, "FAILED" if i % 5 == 0 else "SUCCEEDED", start + timedelta(seconds=i % 7 + 1)))
    return out


def write(spark, folder, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(folder)


def monitored(spark, src, out, look_back=10):
    return monitor.stream_execution_monitor(jobs.table_stream(spark, src, "*.parquet", 1), T0, ["test"], out, look_back=look_back)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("look_back", [10, 0])
def test_overlapping_polls_in_any_order_equal_the_batch(spark, tmp_path, look_back):
    """Also where state is dropped at once and an old poll comes again."""
    src, out, dealt = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(4)
    every = states(40) + [(99, "t0", T0 - timedelta(seconds=11), 1, "RUNNING", None)]
    write(spark, src, dealt.sample(every, 30))
    write(spark, src, every[::-1])
    got = monitored(spark, src, out, look_back)
    batch = execution_monitor(spark.createDataFrame(every, SCHEMA), T0, ["test"])
    assert rows(got.select(*batch.columns)) == rows(batch)
    write(spark, src, [(7, "t1", T0 + timedelta(seconds=7), 1, "RUNNING", None)])
    assert rows(monitored(spark, src, out, look_back).select(*batch.columns)) == rows(batch)


def test_state_ends_with_the_executions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stored = lambda: spark.read.format("statestore").option("joinSide", "none").load(f"{out}/_state_monitor").count()
    write(spark, src, states(40))
    monitored(spark, src, out, look_back=0)
    assert stored() == 40
    write(spark, src, [(100, "t0", T0, 1, "RUNNING", None)])
    monitored(spark, src, out, look_back=0)
    assert stored() == 11  # ten that run on, and the new one


def test_the_setting_is_put_back(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    with monitor.setting(spark, key, "false"):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key) == before


def changes(spark, src, out, look_back, buckets):
    """What each batch passes on, and the state that stays: {id: (last state, may end)}."""
    stream = jobs.table_stream(spark, src, "*.parquet", 1)
    with monitor.setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        news = monitor.execution_changes(stream, look_back=look_back, buckets=buckets)
        passed = jobs.land_batches(news, out, "monitor", lambda rows: rows).collect()
    held = spark.read.format("statestore").option("joinSide", "none").load(f"{out}/_state_monitor").select("value.groupState.*").collect()
    return passed, [dict(zip(h.ids, zip(h.seen, h.until))) for h in held]


def test_many_executions_share_few_states(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    far = 2**60  # a double would lose its last digits
    write(spark, src, [(far + i, *r) for i, *r in states(400)] + [(None, "t0", T0, 1, "RUNNING", None)])
    passed, held = changes(spark, src, out, 10, 3)
    assert {(r.execution_id, r.seq) for r in passed} == {(far + i, 1 + (i % 4 > 0)) for i in range(400)} | {(None, 1)}
    assert len(held) == 3 and sum(map(len, held)) == 401
    assert all((until > 0) == (at == 2) for h in held for at, until in h.values())
    # a state that was seen passes no more, a later one does
    write(spark, src, [(far + i, f"t{i % 3}", T0, 1, "RUNNING", None) for i in range(8)] + [(far, "t0", T0, 3, "ABORTED", T0)])
    again, _ = changes(spark, src, out, 10, 3)
    assert [(r.execution_id, r.seq) for r in again if r not in passed] == [(far, 3)] and len(again) == len(passed) + 1


def test_a_shared_state_drops_what_has_ended(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, states(40))
    assert sum(map(len, changes(spark, src, out, 0, 3)[1])) == 40
    write(spark, src, [(100, "t0", T0, 1, "RUNNING", None)])
    _, held = changes(spark, src, out, 0, 3)
    assert sorted(i for h in held for i in h) == sorted(f"={i}" for i in [*range(0, 40, 4), 100])
