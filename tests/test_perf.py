import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsmill.operators import lifecycle, perf
from newsmill.operators.quantiles import exact_quantiles

# --- fixed values: sample timings
EXECUTION = [1.2, 1.5, 1.1, 2.3, 1.8, 1.4, 1.6, 1.9, 1.3, 1.7]
UPLOAD = [0.1, 0.2, 0.15, 0.12, 0.18, 0.14, 0.16, 0.13, 0.11, 0.17]


def test_timing_summary(spark):
    rows = [("execution", v) for v in EXECUTION] + [("upload", v) for v in UPLOAD] + [("one", 4.0), ("none", None)]
    got = {r.level: r for r in perf.timing_summary(spark.createDataFrame(rows, "level string, seconds double")).collect()}
    e, u = got["execution"], got["upload"]
    assert (round(e["mean"], 3), round(e["median"], 3), round(e["stdev"], 6)) == (1.58, 1.55, 0.361478)
    assert (round(u["mean"], 3), u["max"], u["min"]) == (0.146, 0.2, 0.1)
    assert (got["one"]["stdev"], got["one"]["median"]) == (0.0, 4.0)
    assert tuple(got["none"][c] for c in ("n", "mean", "median", "min", "max", "stdev")) == (0, 0, 0, 0, 0, 0)


def test_scaling_optimal_trend(spark):
    summary = spark.createDataFrame([(1, 1.0), (3, 2.5), (5, 4.2), (10, 7.8)], "level int, mean double")
    got = [(r.factor, round(r.efficiency, 6)) for r in perf.scaling_factors(summary).orderBy("level").collect()]
    assert got == [(1.0, 1.0), (2.5, 1.2), (4.2, 1.190476), (7.8, 1.282051)]
    rates = spark.createDataFrame([(1, 4.0), (2, 9.0), (5, 9.0), (7, 2.0)], "level int, throughput double")
    assert perf.optimal_level(rates).first().level == 2
    t = perf.degradation_trend(rates).first()
    assert (t.trend, t.degraded) == (0.5, True)
    assert perf.degradation_trend(rates.where("level = 1")).count() == 0


@pytest.mark.parametrize("low,band", [(0.95, "excellent"), (0.90, "good"), (0.80, "acceptable"), (0.79, "poor")])
def test_bands(spark, low, band):
    rows = [("a", True)] * 100 + [("b", i < round(low * 100)) for i in range(100)]
    assert perf.stability_band(spark.createDataFrame(rows, "test string, success boolean")).first().band == band


def intervals(spark, pairs):
    t0 = datetime(2024, 1, 1)
    at = lambda s: None if s is None else t0 + timedelta(seconds=s)
    return spark.createDataFrame([(at(a), at(b)) for a, b in pairs], "start_ts timestamp, stop_ts timestamp")


def brute_peak(pairs):
    inside = lambda t: sum(a <= t and (b is None or t < b) for a, b in pairs)
    return max((inside(a) for a, _ in pairs), default=0)


def test_max_concurrent(spark):
    assert perf.max_concurrent(intervals(spark, [(0, 10), (5, 15), (10, 20)])).first()[0] == 2
    assert perf.max_concurrent(intervals(spark, [(0, 0)])).first()[0] == 0
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(a, None if rng.random() < 0.05 else a + rng.choice([0, 1, 30, 60, 400, 5000])) for a in (rng.randrange(7200) for _ in range(150))]
        assert perf.max_concurrent(intervals(spark, pairs)).first()[0] == brute_peak(pairs)


@pytest.mark.parametrize("shape", ["uniform", "one_value", "heavy"])
def test_exact_quantiles(spark, shape):
    rng = random.Random(11)
    draw = {"uniform": lambda: rng.random(), "one_value": lambda: 1.0 if rng.random() < 0.4 else rng.random(), "heavy": lambda: 10 ** rng.uniform(-6, 9)}[shape]
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", draw()) for _ in range(3000)] + [("tiny", 2.0), ("pair", 1.0), ("pair", 4.0)]
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points).collect()
    assert len(got) == len({g for g, _ in rows})
    for r in got:
        values = sorted(v for g, v in rows if g == r.g)
        for name, q in points.items():
            pos = (len(values) - 1) * q
            lo, hi = values[int(pos)], values[min(int(pos) + 1, len(values) - 1)]
            assert r[name] == pytest.approx(lo + (hi - lo) * (pos - int(pos)), rel=1e-12)
        assert r.p50 == pytest.approx(statistics.median(values), rel=1e-12)


def test_execution_monitor(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("x", f"e{i}", s, t0 + timedelta(seconds=d), t0 + timedelta(seconds=d + 4) if s != "RUNNING" else None, 1)
            for i, (s, d) in enumerate([("SUCCEEDED", 0), ("FAILED", 5), ("TIMED_OUT", 9), ("RUNNING", 9), ("ABORTED", -11)])]
    df = spark.createDataFrame(rows + rows[:2], "test string, execution_id string, status string, start_ts timestamp, stop_ts timestamp, seq int")
    r = perf.execution_monitor(df, "2024-01-01 00:00:00", ["test"]).first()
    assert (r.total, r.succeeded, r.failed, r.running, r.success_rate, r.median_seconds) == (4, 1, 2, 1, 0.25, 4.0)


def test_test_log_counts(spark):
    lines = ["5 passed, 2 failed, 1 skipped in 10.5s", "x\n5 passed", "3 passed\n4 passed, 1 failed", "", "7 passed , 1 error in 2s"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, output string")
    pick = lambda rows: [(r.tests_passed, r.tests_failed, r.tests_skipped, r.tests_error, r.tests_run) for r in rows]
    assert pick(perf.test_log_counts(df).orderBy("i").collect()) == [
        (5, 2, 1, None, 8), (5, 0, None, None, 5), (3, 0, None, None, 3), (None,) * 5, (7, None, None, 1, 8)]
    assert pick(perf.test_log_counts(df, strict=True).orderBy("i").collect()) == [
        (None, None, 1, None, None), (5, 0, None, None, 5), (3, 0, None, None, 3), (None,) * 5, (7, None, None, 1, 8)]


def test_zero_guards(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), datetime(2024, 1, 1), False)], "level int, start_ts timestamp, stop_ts timestamp, success boolean")
    r = perf.throughput_success(df).first()
    assert (r.success_rate, r.throughput, r.mean_success_seconds, r.max_success_seconds) == (0, 0, 0, 0)
    e = perf.error_overhead(df.withColumn("seconds", F.lit(1.0))).first()
    assert e.overhead_percent is None


def test_suite_report(spark):
    df = spark.createDataFrame([("a", "fast", True, 1.0, 4, 4), ("b", "fast", False, 3.0, 0, 0), ("c", "slow", True, 3.0, 10, 5)],
                               "suite string, category string, success boolean, seconds double, tests_run int, tests_passed int")
    got = {r.category: r for r in perf.suite_report(df).collect()}
    assert (got["fast"].mean_seconds, got["fast"].suite_pass_rate, got["slow"].test_pass_rate) == (2.0, 0.5, 0.5)
    assert (got[None].slowest_suite, got[None].n_suites, round(got[None].test_pass_rate, 4)) == ("b", 3, 0.6429)


def test_retention(spark):
    now = datetime(2024, 3, 1)
    ago = lambda d: now - timedelta(days=d)
    rows = [("old", 1, ago(31)), ("new", 1, ago(29)), ("v", 1, ago(60)), ("v", 2, ago(8)), ("v", 3, ago(6)), ("w", 1, ago(50)), ("w", 2, ago(50)), ("w", 3, ago(1))]
    df = spark.createDataFrame(rows, "key string, version int, modified_ts timestamp")
    got = {(r.key, r.version): r.action for r in lifecycle.retention_plan(df, "2024-03-01 00:00:00").collect()}
    assert got == {("old", 1): "expire", ("new", 1): "keep", ("v", 1): "delete", ("v", 2): "keep", ("v", 3): "keep",
                   ("w", 1): "delete", ("w", 2): "keep", ("w", 3): "keep"}
    assert {(r.key, r.version) for r in lifecycle.latest_version(df).collect()} == {("old", 1), ("new", 1), ("v", 3), ("w", 3)}


def test_next_in_order_on_hot_key(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = sorted((rng.randrange(40 * 86400), i) for i in range(500))
    df = spark.createDataFrame([("hot", i, t0 + timedelta(seconds=s)) for s, i in rows], "key string, version int, modified_ts timestamp")
    got = {r.version: r.next_ts for r in lifecycle.next_in_order(df, ["key"], "modified_ts", "version").collect()}
    want = {i: t0 + timedelta(seconds=nxt[0]) for (s, i), nxt in zip(rows, rows[1:])}
    assert got == {**want, rows[-1][1]: None}


def test_group_without_a_name_is_kept(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(k, float(v), t0, t0 + timedelta(seconds=v)) for k in (None, "a") for v in (1, 2, 6)]
    df = spark.createDataFrame(rows, "level string, seconds double, start_ts timestamp, stop_ts timestamp")
    assert {r.level: r["median"] for r in perf.timing_summary(df).collect()} == {None: 2.0, "a": 2.0}
    assert {r.level: r.max_concurrent for r in perf.max_concurrent(df, ["level"]).collect()} == {None: 3, "a": 3}
    versions = df.selectExpr("level AS key", "seconds AS version", "stop_ts AS modified_ts")
    assert lifecycle.retention_plan(versions, "2024-01-02 00:00:00").count() == 6
