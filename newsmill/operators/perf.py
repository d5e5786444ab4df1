"""Execution, timing and load analytics.

Every operator first reduces the fact side with map-side combining aggregates;
baselines, ratios and trends are then taken over the per-level summary.
"""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import join_on
from newsmill.functions.text import SPACE, col, ratio
from newsmill.operators.quantiles import exact_quantiles


def _zero(c):
    return F.coalesce(c, F.lit(0.0))


def seconds_between(start, stop):
    return (F.unix_micros(col(stop)) - F.unix_micros(col(start))) / 1e6


def timing_summary(df, level="level", seconds="seconds"):
    """Per level: n, mean, median, min, max, sample deviation (0 for one sample)."""
    s = col(seconds)
    basic = df.groupBy(level).agg(
        F.count(s).alias("n"), _zero(F.avg(s)).alias("mean"), _zero(F.min(s)).alias("min"),
        _zero(F.max(s)).alias("max"), _zero(F.stddev_samp(s)).alias("stdev"),
    )
    median = exact_quantiles(df, [level], seconds, {"median": 0.5})
    return join_on(basic, median, [level], "left").withColumn("median", _zero(F.col("median")))


def throughput_success(df, level="level", start="start_ts", stop="stop_ts", ok="success"):
    """Per level: successes, rate, n / wall seconds, mean and max of successful ones."""
    took = F.when(col(ok), seconds_between(start, stop))
    out = df.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_success"),
        seconds_between(F.min(start), F.max(stop)).alias("wall_seconds"),
        _zero(F.avg(took)).alias("mean_success_seconds"), _zero(F.max(took)).alias("max_success_seconds"),
    )
    return out.withColumn("success_rate", ratio("n_success", "n")).withColumn("throughput", ratio("n", "wall_seconds"))


def scaling_factors(summary, level="level", mean="mean", by=()):
    """Against the smallest level: time factor and efficiency.

    ``summary`` has one row per level (the output of ``timing_summary``), so the
    frame for the base row spans levels, never samples.
    """
    base = W.partitionBy(*by).orderBy(level).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = summary.withColumn("base_level", F.first(level).over(base)).withColumn("base_mean", F.first(mean).over(base))
    out = out.withColumn("factor", ratio(mean, "base_mean"))
    return out.withColumn("efficiency", ratio(ratio(level, "base_level"), "factor")).drop("base_level", "base_mean")


def optimal_level(summary, level="level", throughput="throughput", by=()):
    """Level with the highest throughput, the lowest such level on ties."""
    best = F.max_by(F.struct(level, throughput), F.struct(throughput, -col(level))).alias("b")
    return summary.groupBy(*by).agg(best).select(*by, f"b.{level}", f"b.{throughput}")


def degradation_trend(summary, level="level", throughput="throughput", by=()):
    """Throughput of the last level over the first; degraded below 0.8. Groups
    with a single level have no trend."""
    out = summary.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_levels"), F.min_by(throughput, level).alias("first_throughput"),
        F.max_by(throughput, level).alias("last_throughput"),
    )
    trend = F.when(F.col("first_throughput") > 0, F.col("last_throughput") / F.col("first_throughput")).otherwise(0.0)
    return out.where("n_levels >= 2").withColumn("trend", trend).withColumn("degraded", F.col("trend") < 0.8)


def distinct_executions(df, id="execution_id", order=("seq",)):
    """Latest record per execution id; combines before the shuffle."""
    rest = [c for c in df.columns if c != id]
    return df.groupBy(id).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(id, "s.*")


def execution_monitor(df, since, by, id="execution_id", status="status", start="start_ts", stop="stop_ts", order=("seq",)):
    """Per test: totals by outcome, success rate, durations of stopped executions.

    Reads back 10 s before ``since`` and counts every execution id once.
    """
    seen = df.where(col(start) >= F.lit(since).cast("timestamp") - F.expr("INTERVAL 10 SECONDS"))
    once = distinct_executions(seen.select(*by, id, status, start, stop, *order), id, order)
    once = once.withColumn("seconds", seconds_between(start, stop))
    s = col(status)
    totals = once.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "SUCCEEDED").alias("succeeded"),
        F.count_if(s.isin(dims.FAILED_EXECUTIONS)).alias("failed"), F.count_if(s == "RUNNING").alias("running"),
        _zero(F.avg("seconds")).alias("mean_seconds"), _zero(F.min("seconds")).alias("min_seconds"),
        _zero(F.max("seconds")).alias("max_seconds"), _zero(F.stddev_samp("seconds")).alias("stdev_seconds"),
    )
    median = exact_quantiles(once, by, "seconds", {"median_seconds": 0.5})
    out = join_on(totals, median, list(by), "left").withColumn("median_seconds", _zero(F.col("median_seconds")))
    return out.withColumn("success_rate", ratio("succeeded", "total"))


def instants(df, by, start, stop, bucket_seconds):
    """Net change of open intervals per group and instant, with the instant's bucket."""
    at = lambda c, d: F.struct(F.unix_micros(col(c)).alias("t"), F.lit(d).alias("d"))
    edges = F.explode(F.array(at(start, 1), at(stop, -1))).alias("e")
    points = df.where(col(start).isNotNull()).select(*by, edges).where("e.t IS NOT NULL")
    points = points.groupBy(*by, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    return points.withColumn("bucket", F.floor(F.col("t") / F.lit(bucket_seconds * 1000000)).cast("long"))


def max_concurrent(df, by=(), start="start_ts", stop="stop_ts", bucket_seconds=60):
    """Exact peak number of half-open intervals open at once, per group.

    Sweep line in two levels. Changes are summed per instant (map-side), then per
    bucket; running totals go over buckets first and then inside each bucket, so
    the only frames are one row per bucket of the calendar and the instants of
    one bucket. A group that holds a large share of all rows is spread over its
    buckets.
    """
    by = list(by)
    points = instants(df, by, start, stop, bucket_seconds)
    buckets = points.groupBy(*by, "bucket").agg(F.sum("d").alias("bd"))
    earlier = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    opening = buckets.select(*by, "bucket", F.coalesce(F.sum("bd").over(earlier), F.lit(0)).alias("opening"))
    running = F.sum("d").over(W.partitionBy(*by, "bucket").orderBy("t"))
    inside = points.withColumn("r", running).groupBy(*by, "bucket").agg(F.max("r").alias("r"))
    peak = F.greatest(F.lit(0), F.max(F.col("r") + F.col("opening"))).cast("long").alias("max_concurrent")
    return join_on(inside, opening, [*by, "bucket"]).groupBy(*by).agg(peak)


def concurrency_stats(df, by):
    """Peak, success rate, mean time and its sample deviation per test."""
    once = distinct_executions(df)
    peak = max_concurrent(once, by)
    s = F.col("status")
    took = seconds_between("start_ts", "stop_ts")
    stats = once.groupBy(*by).agg(
        ratio(F.count_if(s == "SUCCEEDED"), F.count(F.lit(1))).alias("efficiency"),
        _zero(F.avg(took)).alias("mean_seconds"), _zero(F.stddev_samp(took)).alias("duration_stddev"),
    )
    return join_on(stats, peak, list(by), "left")


def stability_band(df, test="test", ok="success", by=()):
    """Mean and lowest success rate over tests, and the band of the lowest."""
    rates = df.groupBy(*by, test).agg(ratio(F.count_if(ok), F.count(F.lit(1))).alias("rate"))
    out = rates.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tests"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("min_rate"))
    low = F.col("min_rate")
    return out.withColumn(
        "band", F.when(low >= 0.95, "excellent").when(low >= 0.90, "good").when(low >= 0.80, "acceptable").otherwise("poor")
    )


def load_summary(df, test="test", start="start_ts", stop="stop_ts", uploaded="uploaded", succeeded="succeeded"):
    """Per load test: uploads, rates per elapsed second, errors, error rate."""
    up, took = col(uploaded), seconds_between(start, stop)
    out = df.groupBy(test).agg(
        F.count(F.lit(1)).alias("total_uploads"), F.count_if(up).alias("ok_uploads"), F.count_if(~up).alias("upload_errors"),
        F.count_if(up & col(succeeded)).alias("ok_runs"),
        seconds_between(F.min(start), F.max(stop)).alias("elapsed_seconds"),
        _zero(F.avg(F.when(up, took))).alias("mean_upload_seconds"), _zero(F.max(F.when(up, took))).alias("max_upload_seconds"),
    )
    return (
        out.withColumn("success_rate", ratio("ok_uploads", "total_uploads"))
        .withColumn("actual_rate", ratio("ok_uploads", "elapsed_seconds"))
        .withColumn("error_rate", 1 - ratio("ok_runs", "ok_uploads"))
    )


def rate_windows(df, ts="ts", period="1 hour", target_per_second=dims.RATE_PROFILES[0][1]):
    """Events per period, per second, and whether the target rate was met."""
    width = F.window(col(ts), period)
    out = df.groupBy(width.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    span = seconds_between("w.start", "w.end")
    return out.select(
        F.col("w.start").alias("period_start"), "n", (F.col("n") / span).alias("per_second"),
        (F.col("n") / span >= target_per_second).alias("met_target"),
    )


def error_overhead(df, by=(), seconds="seconds", ok="success", limit=1.5):
    """Mean time of failures against successes, in percent, and the limit check."""
    s = col(seconds)
    out = df.groupBy(*by).agg(F.avg(F.when(col(ok), s)).alias("ok_mean"), F.avg(F.when(~col(ok), s)).alias("error_mean"))
    overhead = (F.try_divide(F.col("error_mean"), F.col("ok_mean")) - 1) * 100
    return out.withColumn("overhead_percent", overhead).withColumn("within_limit", F.col("error_mean") < F.col("ok_mean") * limit)


def resource_ratio(df, size_bytes, before_mb, after_mb):
    """Adds size in MB, increase, and size per increase (0 when not increasing)."""
    size = col(size_bytes) / F.lit(1024.0 * 1024.0)
    increase = col(after_mb) - col(before_mb)
    return df.withColumns(
        {"size_mb": size, "increase_mb": increase, "efficiency": F.when(increase > 0, size / increase).otherwise(0.0)}
    )


def size_profile(df, scenario="scenario", text="text", literal="<a ", seconds=None):
    """Per scenario: items, total and mean length, occurrences of a literal, rate."""
    t = col(text)
    hits = F.regexp_count(t, F.lit(rf"\Q{literal}\E"))
    out = df.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(F.length(t)).alias("total_length"),
        F.avg(F.length(t)).alias("mean_length"), F.sum(hits).alias("n_literal"),
        *([F.sum(seconds).alias("seconds")] if seconds is not None else []),
    )
    return out if seconds is None else out.withColumn("items_per_second", ratio("n_items", "seconds"))


FLAG_LIMITS = {
    "worst_scaling": dims.SCALING_LIMIT, "best_throughput": dims.THROUGHPUT_FLOOR,
    "single_item_mean": dims.SINGLE_ITEM_LIMIT, "memory_increase": dims.MEMORY_LIMIT_MB,
}
FLAG_FLOORS = {"best_throughput"}  # the others must not exceed their limit


def perf_flags(*frames):
    """Checks (check, value, limit, ok) from (frame, {check: column}) pairs. One
    aggregate per frame takes the largest value of each of its checks."""
    def flag(check):
        v, limit = F.col(check), F.lit(FLAG_LIMITS[check])
        ok = v >= limit if check in FLAG_FLOORS else v <= limit
        return F.struct(F.lit(check).alias("check"), v.alias("value"), limit.alias("limit"), ok.alias("ok"))

    rows = []
    for frame, checks in frames:
        largest = frame.agg(*[F.max(col(c)).cast("double").alias(name) for name, c in checks.items()])
        rows.append(largest.select(F.inline(F.array(*map(flag, checks)))))
    return reduce(lambda a, b: a.unionByName(b), rows)


def suite_report(df, suite="suite", category="category", ok="success", seconds="seconds", tests="tests_run", passed="tests_passed"):
    """Per category and for all (null category): suites, tests, pass rates, mean
    time, slowest suite; zero where nothing ran."""
    out = df.rollup(category).agg(
        F.count(F.lit(1)).alias("n_suites"), F.count_if(ok).alias("passed_suites"),
        F.sum(tests).alias("tests_run"), F.sum(passed).alias("tests_passed"),
        F.avg(seconds).alias("mean_seconds"), F.sum(seconds).alias("total_seconds"),
        F.min_by(suite, F.struct((-col(seconds)).alias("s"), col(suite).alias("n"))).alias("slowest_suite"),
    )
    return out.withColumn("suite_pass_rate", ratio("passed_suites", "n_suites")).withColumn(
        "test_pass_rate", ratio("tests_passed", "tests_run")
    )


def _full_line(l):
    return l.contains("passed") & (l.contains("failed") | l.contains("error") | l.contains("skipped"))


def summary_line(output="output"):
    """First line that names passed tests and others, or ends with "passed"."""
    ends = rf"passed{SPACE}*\z"
    lines = F.filter(F.split(col(output), "\n"), lambda l: l.contains("passed"))
    return F.try_element_at(F.filter(lines, lambda l: _full_line(l) | l.rlike(ends)), F.lit(1))


def test_log_counts(df, output="output", strict=False, line=None):
    """Counts from the first summary line of a test run's output; ``line`` names a
    column that holds this line already.

    ``strict`` keeps the whole-token rule, under which ``5 passed,`` with its
    comma is not counted.
    """
    rows = df.withColumn("_line", summary_line(output) if line is None else col(line))

    def count(word):
        after = r"(?=\s|$)" if strict else r"\b"
        before = r"(?:^|\s)" if strict else ""
        found = F.regexp_extract(F.col("_line"), rf"{before}(\d+)\s+{word}{after}", 1)
        return F.nullif(found, F.lit("")).cast("long")

    names = ["passed", "failed", "skipped", "error"]
    rows = rows.withColumns({f"tests_{n}": count(n) for n in names})
    # a bare "n passed" line says that nothing failed
    only = ~_full_line(F.col("_line"))
    rows = rows.withColumn("tests_failed", F.when(only & F.col("tests_passed").isNotNull(), F.lit(0)).otherwise(F.col("tests_failed")))
    total = F.col("tests_passed")
    for n in names[1:]:
        total = total + F.coalesce(F.col(f"tests_{n}"), F.lit(0))
    return rows.withColumn("tests_run", total).drop("_line")


test_log_counts.__test__ = False


def report_rows(summary, test="test", level="level", figures=("success_rate", "throughput", "mean_seconds")):
    """Per test the headline figures at its largest level."""
    top = F.max_by(F.struct(level, *figures), level).alias("t")
    return summary.groupBy(test).agg(top).select(test, "t.*")


def latency_percentiles(df, by, seconds="seconds", exact=True, parts=1):
    """p50, p90, p95, p99 per group; ``exact=False`` uses the mergeable sketch, ``parts``
    is for groups of over 10^9 values (``exact_quantiles``)."""
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    if exact:
        return exact_quantiles(df, by, seconds, points, parts)
    sketch = F.percentile_approx(seconds, list(points.values()), 10000).alias("p")
    return df.groupBy(*by).agg(sketch).select(*by, *[F.col("p")[i].alias(n) for i, n in enumerate(points)])
