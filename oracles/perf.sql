-- part: timed
SELECT *, json_extract_string(props, '$.k')::INTEGER % 5 + 1 AS level, epoch_us(ts) AS a, epoch_us(ts) + round(value * 1000000)::BIGINT AS z, event_type <> 'error' AS success FROM events

-- name: timing_summary
SELECT level, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(median(value), 6) AS median FROM ({{timed}}) GROUP BY level

-- part: level_throughput
SELECT level, count(*) AS n, count(*) FILTER (WHERE success) AS n_success, (max(z) - min(a)) / 1e6 AS wall_seconds,
  avg((z - a) / 1e6) FILTER (WHERE success) AS mean_success_seconds, max((z - a) / 1e6) FILTER (WHERE success) AS max_success_seconds FROM ({{timed}}) GROUP BY level

-- name: throughput_success
SELECT level, n, n_success, round(wall_seconds, 6) AS wall_seconds, round(mean_success_seconds, 6) AS mean_success_seconds, round(max_success_seconds, 6) AS max_success_seconds,
  round(n_success / n, 6) AS success_rate, round(n / wall_seconds, 6) AS throughput FROM ({{level_throughput}})

-- part: scaling
SELECT level, mean, mean / first_value(mean) OVER (ORDER BY level) AS factor, first_value(level) OVER (ORDER BY level) AS base
FROM (SELECT level, avg(value) AS mean FROM ({{timed}}) GROUP BY level)

-- name: scaling_factors
SELECT level, round(mean, 6) AS mean, round(factor, 6) AS factor, round(level / base / factor, 6) AS efficiency FROM ({{scaling}})

-- part: by_day
SELECT strftime(ts, '%Y-%m-%d') AS day, level, round(count(*) / greatest(sum(value), 1.0), 3) AS throughput FROM ({{timed}}) GROUP BY ALL

-- name: optimal_level
SELECT day, level, throughput FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY throughput DESC, level) AS rn FROM ({{by_day}})) WHERE rn = 1

-- name: degradation_trend
WITH g AS (SELECT day, count(*) AS n_levels, arg_min(throughput, level) AS first_throughput, arg_max(throughput, level) AS last_throughput FROM ({{by_day}}) GROUP BY day),
t AS (SELECT *, CASE WHEN first_throughput > 0 THEN last_throughput / first_throughput ELSE 0 END AS x FROM g WHERE n_levels >= 2)
SELECT day, n_levels, first_throughput, last_throughput, round(x, 6) AS trend, x < 0.8 AS degraded FROM t

-- part: final_executions
SELECT event_id, event_type AS test, ts, status, a, CASE WHEN status <> 'RUNNING' THEN z END AS z, CASE WHEN status <> 'RUNNING' THEN (z - a) / 1e6 END AS s
FROM (SELECT *, ['SUCCEEDED','SUCCEEDED','SUCCEEDED','FAILED','TIMED_OUT','ABORTED','RUNNING'][user_id % 7 + 1] AS status FROM ({{timed}}))

-- name: execution_monitor
SELECT test, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status IN ('FAILED','TIMED_OUT','ABORTED')) AS failed,
  count(*) FILTER (WHERE status = 'RUNNING') AS running, round(coalesce(avg(s), 0), 6) AS mean_seconds, round(coalesce(min(s), 0), 6) AS min_seconds, round(coalesce(max(s), 0), 6) AS max_seconds,
  round(coalesce(stddev_samp(s), 0), 6) AS stdev_seconds, round(coalesce(median(s), 0), 6) AS median_seconds, round(count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS success_rate
FROM ({{final_executions}}) WHERE ts >= TIMESTAMP '2024-01-09 23:59:50' GROUP BY test

-- name: stream_execution_monitor
SELECT test, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status IN ('FAILED','TIMED_OUT','ABORTED')) AS failed,
  count(*) FILTER (WHERE status = 'RUNNING') AS running, round(coalesce(avg(s), 0), 6) AS mean_seconds, round(coalesce(min(s), 0), 6) AS min_seconds, round(coalesce(max(s), 0), 6) AS max_seconds,
  round(coalesce(stddev_samp(s), 0), 6) AS stdev_seconds, round(coalesce(median(s), 0), 6) AS median_seconds, round(count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS success_rate
FROM ({{final_executions}}) WHERE ts >= TIMESTAMP '2024-01-09 23:59:50' GROUP BY test

-- name: execution_monitor_overall
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status IN ('FAILED','TIMED_OUT','ABORTED')) AS failed,
  count(*) FILTER (WHERE status = 'RUNNING') AS running, round(coalesce(avg(s), 0), 6) AS mean_seconds, round(coalesce(min(s), 0), 6) AS min_seconds, round(coalesce(max(s), 0), 6) AS max_seconds,
  round(coalesce(stddev_samp(s), 0), 6) AS stdev_seconds, round(coalesce(median(s), 0), 6) AS median_seconds, round(count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS success_rate
FROM ({{final_executions}}) WHERE ts >= TIMESTAMP '2024-01-09 23:59:50'

-- name: max_concurrent
SELECT event_type, max(r)::BIGINT AS max_concurrent FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT event_type, a AS t, 1 AS d FROM ({{timed}}) UNION ALL SELECT event_type, z, -1 FROM ({{timed}}))) GROUP BY event_type

-- name: max_concurrent_overall
SELECT max(r)::BIGINT AS max_concurrent FROM (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT a AS t, 1 AS d FROM ({{timed}}) UNION ALL SELECT z, -1 FROM ({{timed}})))

-- name: concurrency_history
WITH c AS (SELECT event_type, t, sum(d) AS d FROM (SELECT event_type, a AS t, 1 AS d FROM ({{timed}}) UNION ALL SELECT event_type, z, -1 FROM ({{timed}})) GROUP BY event_type, t),
r AS (SELECT event_type, make_timestamp(t)::DATE AS day, t, d, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS r FROM c)
SELECT event_type, day, arg_min(r - d, t)::BIGINT AS opening, greatest(0, arg_min(r - d, t), max(r))::BIGINT AS max_concurrent FROM r GROUP BY event_type, day

-- name: concurrency_stats
WITH f AS ({{final_executions}}),
p AS (SELECT test, max(r)::BIGINT AS max_concurrent FROM (SELECT test, sum(d) OVER (PARTITION BY test ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT test, a AS t, 1 AS d FROM f UNION ALL SELECT test, z, -1 FROM f WHERE z IS NOT NULL)) GROUP BY test)
SELECT test, round(count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS efficiency, round(coalesce(avg(s), 0), 6) AS mean_seconds,
  round(coalesce(stddev_samp(s), 0), 6) AS duration_stddev, any_value(max_concurrent) AS max_concurrent FROM f JOIN p USING (test) GROUP BY test

-- name: concurrency_stats_overall
WITH f AS ({{final_executions}}),
p AS (SELECT max(r)::BIGINT AS max_concurrent FROM (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT a AS t, 1 AS d FROM f UNION ALL SELECT z, -1 FROM f WHERE z IS NOT NULL)))
SELECT round(count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS efficiency, round(coalesce(avg(s), 0), 6) AS mean_seconds,
  round(coalesce(stddev_samp(s), 0), 6) AS duration_stddev, (SELECT max_concurrent FROM p) AS max_concurrent FROM f

-- name: stability_band
WITH r AS (SELECT level, user_id, count(*) FILTER (WHERE success) / count(*) AS rate FROM ({{timed}}) GROUP BY level, user_id)
SELECT level, count(*) AS n_tests, round(avg(rate), 6) AS mean_rate, round(min(rate), 6) AS min_rate,
  CASE WHEN min(rate) >= 0.95 THEN 'excellent' WHEN min(rate) >= 0.9 THEN 'good' WHEN min(rate) >= 0.8 THEN 'acceptable' ELSE 'poor' END AS band FROM r GROUP BY level

-- name: load_summary
WITH g AS (SELECT level AS test, count(*) AS total_uploads, count(*) FILTER (WHERE success) AS ok_uploads, count(*) FILTER (WHERE NOT success) AS upload_errors,
  count(*) FILTER (WHERE success AND event_id % 9 <> 0) AS ok_runs, (max(z) - min(a)) / 1e6 AS e, avg((z - a) / 1e6) FILTER (WHERE success) AS m, max((z - a) / 1e6) FILTER (WHERE success) AS x
  FROM ({{timed}}) GROUP BY level)
SELECT test, total_uploads, ok_uploads, upload_errors, ok_runs, round(e, 6) AS elapsed_seconds, round(m, 6) AS mean_upload_seconds, round(x, 6) AS max_upload_seconds,
  round(ok_uploads / total_uploads, 6) AS success_rate, round(ok_uploads / e, 6) AS actual_rate, round(1 - ok_runs / ok_uploads, 6) AS error_rate FROM g

-- name: rate_windows
SELECT epoch(date_trunc('hour', ts))::BIGINT AS period_start, count(*) AS n, round(count(*) / 3600, 6) AS per_second, count(*) / 3600 >= 0.004 AS met_target FROM events GROUP BY 1

-- name: rate_profiles
SELECT profile::INTEGER AS profile, (floor(epoch(ts))::BIGINT // s) * s AS period_start, count(*) AS n, round(count(*) / s::DOUBLE, 6) AS per_second, count(*) / s::DOUBLE >= rate AS met_target
FROM events, (VALUES (0, 60::BIGINT, 2.0), (1, 30::BIGINT, 5.0), (2, 45::BIGINT, 3.0)) AS p(profile, s, rate) GROUP BY profile, s, rate, 2

-- name: stream_rate_windows
SELECT epoch(date_trunc('hour', ts))::BIGINT AS period_start, count(*) AS n FROM events GROUP BY 1

-- name: error_overhead
WITH g AS (SELECT level, avg(value) FILTER (WHERE success) AS o, avg(value) FILTER (WHERE NOT success) AS e FROM ({{timed}}) GROUP BY level)
SELECT level, round(o, 6) AS ok_mean, round(e, 6) AS error_mean, round((e / o - 1) * 100, 6) AS overhead_percent, e < o * 1.5 AS within_limit FROM g

-- name: resource_ratio
WITH r AS (SELECT doc_id, n_chars * 1000 / 1048576.0::DOUBLE AS size, length(text) / 256.0::DOUBLE - 1.5 AS inc FROM documents)
SELECT doc_id, round(size, 6) AS size_mb, round(inc, 6) AS increase_mb, round(CASE WHEN inc > 0 THEN size / inc ELSE 0 END, 6) AS efficiency FROM r

-- name: size_profile
WITH g AS (SELECT split_part(url, ':', 1) AS scenario, count(*) AS n_items, sum(length(html))::BIGINT AS total_length, avg(length(html)) AS m,
  sum(len(regexp_extract_all(html, '<a ')))::BIGINT AS n_literal, sum(page_id % 5 + 1)::DOUBLE AS seconds FROM pages GROUP BY 1)
SELECT scenario, n_items, total_length, round(m, 6) AS mean_length, n_literal, seconds, round(n_items / seconds, 6) AS items_per_second FROM g

-- name: perf_flags
SELECT 'worst_scaling' AS check, round(max(factor), 6) AS value, 5.0::DOUBLE AS "limit", max(factor) <= 5 AS ok FROM ({{scaling}})
UNION ALL SELECT 'best_throughput', round(max(n / wall_seconds), 6), 1.0, max(n / wall_seconds) >= 1 FROM ({{level_throughput}})
UNION ALL SELECT 'single_item_mean', round(avg(value), 6), 2.0, avg(value) <= 2 FROM ({{timed}}) WHERE level = 1
UNION ALL SELECT 'memory_increase', round(max(n_chars) / 1024.0::DOUBLE, 6), 100.0, max(n_chars) / 1024.0 <= 100 FROM documents

-- part: suites
SELECT o_orderkey::VARCHAR AS suite, CASE WHEN o_orderpriority < '2' THEN 'fast' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'slow' END AS category,
  o_orderstatus <> 'F' AS ok, o_totalprice / 1000 AS s, o_custkey % 50 AS t, o_custkey % 50 // 2 AS p FROM orders

-- name: suite_report
WITH s AS ({{suites}}),
g AS (SELECT category, count(*) AS n_suites, count(*) FILTER (WHERE ok) AS passed_suites, sum(t)::BIGINT AS tests_run, sum(p)::BIGINT AS tests_passed, avg(s) AS m, sum(s) AS x,
    arg_min(suite, (-s, suite)) AS slowest_suite FROM s GROUP BY ROLLUP (category))
SELECT category, n_suites, passed_suites, tests_run, tests_passed, round(m, 6) AS mean_seconds, round(x, 6) AS total_seconds, slowest_suite,
  round(passed_suites / n_suites, 6) AS suite_pass_rate, round(CASE WHEN tests_run = 0 THEN 0 ELSE tests_passed / tests_run END, 6) AS test_pass_rate FROM g

-- name: test_log_counts
WITH l AS (SELECT l_partkey % 3 AS k, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS f, l_suppkey % 7 AS s FROM lineitem)
SELECT 'tolerant' AS mode, sum(q) FILTER (WHERE k < 2)::BIGINT AS tests_passed, sum(CASE k WHEN 0 THEN f WHEN 1 THEN 0 END)::BIGINT AS tests_failed,
  sum(s) FILTER (WHERE k = 0)::BIGINT AS tests_skipped, sum(CASE k WHEN 0 THEN q + f + s WHEN 1 THEN q END)::BIGINT AS tests_run FROM l
UNION ALL SELECT 'strict', sum(q) FILTER (WHERE k = 1)::BIGINT, sum(0) FILTER (WHERE k = 1)::BIGINT, sum(s) FILTER (WHERE k = 0)::BIGINT, sum(q) FILTER (WHERE k = 1)::BIGINT FROM l

-- name: report_rows
WITH g AS (SELECT user_id AS test, level, count(*) FILTER (WHERE success) / count(*) AS r, coalesce(count(*) / nullif((max(z) - min(a)) / 1e6, 0), 0) AS n, avg(value) AS m FROM ({{timed}}) GROUP BY ALL)
SELECT test, level, round(r, 6) AS success_rate, round(n, 6) AS throughput, round(m, 6) AS mean_seconds FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY level DESC) AS rn FROM g) WHERE rn = 1

-- name: latency_percentiles
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type

-- name: latency_percentiles_overall
SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events

-- name: price_percentiles
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY l_returnflag

-- name: latency_history
{{span_all}} UNION ALL {{span_week}}

-- part: span_all
SELECT 'all' AS span, event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type

-- part: span_week
SELECT 'week' AS span, event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type

-- name: version_history
WITH v AS (SELECT o_custkey AS key, o_orderkey AS version, o_orderdate AS m, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)
SELECT key, version, nx IS NULL AS is_current, epoch(nx)::BIGINT AS next_ts,
  CASE WHEN nx IS NULL AND m < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY THEN 'expire' WHEN nx < TIMESTAMP '2001-06-01' - INTERVAL 7 DAY THEN 'delete' ELSE 'keep' END AS action FROM v

-- name: retention_plan
WITH v AS (SELECT o_custkey AS key, o_orderkey AS version, o_orderdate AS m, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)
SELECT key, version, nx IS NULL AS is_current, epoch(nx)::BIGINT AS next_ts,
  CASE WHEN nx IS NULL AND m < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY THEN 'expire' WHEN nx < TIMESTAMP '2001-06-01' - INTERVAL 7 DAY THEN 'delete' ELSE 'keep' END AS action FROM v

-- name: latest_version
SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version, epoch(max(o_orderdate))::BIGINT AS modified_ts FROM orders GROUP BY o_custkey

-- name: type_rollup
SELECT p_type, p_name, p_partkey, count(*) OVER (PARTITION BY p_type) AS n_in_type FROM part

-- name: scalar_helpers
SELECT event_id, upper(event_type[1]) || event_type[2:] || ' By User' AS title, event_type || '.example.org' AS host FROM events
