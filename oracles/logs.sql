-- name: log_parse
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'plain text ' || event_id WHEN event_id % 11 = 0 THEN '{"level":' || event_id
    ELSE '{"level":"' || event_type || '","message":"m' || event_id || '","context":' || props || ',"execution_time":' || value::DECIMAL(12,2) || '}' END AS line,
  ok AS is_structured, CASE WHEN ok THEN event_type END AS level, CASE WHEN ok THEN 'm' || event_id END AS message,
  CASE WHEN ok THEN json_extract_string(props, '$.k') END AS k, CASE WHEN ok THEN value END AS execution_time
FROM (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AS ok FROM events)

-- part: errors
SELECT event_id, user_id, event_type, ts, value,
  CASE WHEN event_id % 5 <> 0 THEN ['ValidationError','AuthenticationError','NetworkError','ClientError','TimeoutError','FileNotFoundError','PermissionError'][event_id % 7 + 1] END AS error_type,
  ['AuthFailure','ThrottlingException','InternalError','RequestLimitExceeded','ExpiredCredential'][event_id % 5 + 1] AS error_code,
  ['Invalid input','Connection reset','network unreachable','boom'][(event_id // 7) % 4 + 1] AS error_message,
  CASE WHEN event_id % 3 = 0 THEN ['input_validation','network','rate_limit','processing','storage','configuration'][event_id % 6 + 1] END AS category,
  ['INFO','CRITICAL','ERROR','WARNING','DEBUG'][user_id % 5 + 1] AS level, ['ERROR','WARNING','NOTICE'][event_id % 3 + 1] AS severity,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso
FROM events

-- name: log_build
SELECT event_id, '{"timestamp":"' || iso || '","level":"' || level || '","message":"event ' || event_type || '","context":{"user":"' || user_id || '"},"execution_time":' || value::VARCHAR
  || CASE WHEN error_type IS NULL THEN '' ELSE ',"error":{"type":"' || error_type || '","message":"' || error_message || '"' || CASE WHEN category IS NULL THEN '' ELSE ',"category":"' || category || '"' END || '}' END
  || CASE WHEN event_id % 2 = 0 THEN ',"metrics":{"n":"1"}' ELSE '' END || '}' AS record_json FROM ({{errors}})

-- part: categories
SELECT *, coalesce(category, CASE WHEN error_type IS NULL THEN NULL WHEN error_type = 'ValidationError' THEN 'input_validation' WHEN error_type = 'AuthenticationError' THEN 'authentication'
  WHEN error_type = 'NetworkError' THEN 'external_service'
  WHEN error_type = 'ClientError' THEN CASE WHEN error_code LIKE '%Auth%' OR error_code LIKE '%Credential%' THEN 'authentication' WHEN error_code LIKE '%Throttling%' OR error_code LIKE '%Limit%' THEN 'rate_limit' ELSE 'external_service' END
  WHEN lower(error_message) LIKE '%network%' OR lower(error_message) LIKE '%connection%' THEN 'network' ELSE 'unknown' END) AS error_category FROM ({{errors}})

-- name: error_category
SELECT event_id, error_category FROM ({{categories}})

-- name: alert_feed
WITH a AS (SELECT event_id, CASE WHEN level = 'CRITICAL' THEN 'CRITICAL' ELSE severity END AS s FROM ({{errors}})
  WHERE (level = 'CRITICAL' AND event_id % 4 <> 0) OR (level <> 'CRITICAL' AND event_id % 6 = 0))
SELECT event_id, s AS alert_severity, CASE s WHEN 'CRITICAL' THEN '🚨' WHEN 'WARNING' THEN '⚡' ELSE '⚠️' END AS emoji,
  CASE s WHEN 'CRITICAL' THEN 'danger' WHEN 'WARNING' THEN 'good' ELSE 'warning' END AS color FROM a

-- part: suggestions
SELECT *, CASE category WHEN 'input_validation' THEN 'Check input data format and required fields' WHEN 'rate_limit' THEN 'Implement exponential backoff and reduce request frequency'
    WHEN 'network' THEN 'Check network connectivity and DNS resolution' WHEN 'configuration' THEN 'Verify environment variables and resource configurations'
    WHEN 'processing' THEN 'Review input data and processing logic' ELSE 'Review logs and check system status' END
  || CASE WHEN error_type LIKE '%Timeout%' THEN ', increase timeout values' WHEN error_type LIKE '%Permission%' OR error_type LIKE '%Access%' THEN ', check IAM roles and policies'
    WHEN error_type LIKE '%NotFound%' THEN ', verify resource exists and paths are correct' ELSE '' END AS suggestion FROM ({{errors}})

-- name: alert_suggestions
SELECT event_id, suggestion FROM ({{suggestions}})

-- part: alert_texts
WITH x AS (SELECT *, repeat('ab', (event_id % 80)::INTEGER) AS note FROM ({{suggestions}})),
t AS (SELECT event_id, concat_ws(chr(10), '*Severity:* ' || severity, '*Message:* event ' || event_type,
  '*Error Type:* ' || error_type, CASE WHEN error_type IS NOT NULL THEN '*Error Details:* ' || error_message END,
  '*Category:* ' || CASE category WHEN 'input_validation' THEN 'Input Validation' WHEN 'rate_limit' THEN 'Rate Limit' WHEN 'network' THEN 'Network'
     WHEN 'processing' THEN 'Processing' WHEN 'storage' THEN 'Storage' WHEN 'configuration' THEN 'Configuration' END,
  '*Timestamp:* ' || iso, '*Key Details:* Function Name: ' || event_type || ', Request Id: req-' || user_id,
  '*Additional Context:* Note: ' || CASE WHEN length(note) > 100 THEN left(note, 97) || '...' ELSE note END,
  CASE WHEN category IS NOT NULL THEN '*Suggested Actions:* ' || suggestion END) AS s FROM x)
SELECT event_id, s FROM t

-- name: alert_format
SELECT event_id, length(s)::INTEGER AS n, md5(s) AS digest FROM ({{alert_texts}})

-- name: alert_payload
WITH a AS (SELECT event_id, ts, CASE WHEN level = 'CRITICAL' THEN 'CRITICAL' ELSE severity END AS v FROM ({{errors}})
  WHERE (level = 'CRITICAL' AND event_id % 4 <> 0) OR (level <> 'CRITICAL' AND event_id % 6 = 0))
SELECT event_id, v AS alert_severity, '{"text":"' || CASE v WHEN 'CRITICAL' THEN '🚨' WHEN 'WARNING' THEN '⚡' ELSE '⚠️' END || ' ' || v || ' Alert - newsmill","attachments":[{"color":"'
  || CASE v WHEN 'CRITICAL' THEN 'danger' WHEN 'WARNING' THEN 'good' ELSE 'warning' END || '","fields":[{"title":"Error Details","value":' || to_json(s)::VARCHAR
  || ',"short":false}],"footer":"newsmill Admin Notifications","ts":' || floor(epoch(ts))::BIGINT || '}]}' AS payload
FROM a JOIN ({{alert_texts}}) USING (event_id)

-- part: marks
SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS run_id, event_type AS name, ts, event_id AS seq, value, event_id FROM events

-- part: days
SELECT run_id, min(ts) AS start_ts, max(ts) AS end_ts FROM ({{marks}}) GROUP BY run_id

-- name: checkpoint_offsets
SELECT run_id, m.name, round((epoch_us(m.at) - epoch_us(d.start_ts)) / 1e6, 3) AS offset_seconds, round((epoch_us(d.end_ts) - epoch_us(d.start_ts)) / 1e6, 3) AS total_execution_time
FROM (SELECT run_id, name, arg_max(ts, seq) AS at FROM ({{marks}}) GROUP BY run_id, name) m JOIN ({{days}}) d USING (run_id)

-- name: stage_durations
WITH n AS (SELECT run_id, ['fetch','parse','send'][seq % 3 + 1] AS stage, ['start','complete'][(seq // 3) % 2 + 1] AS kind, ts, seq FROM ({{marks}})),
p AS (SELECT run_id, stage, arg_max(ts, seq) FILTER (WHERE kind = 'start') AS s, arg_max(ts, seq) FILTER (WHERE kind = 'complete') AS c FROM n GROUP BY run_id, stage)
SELECT run_id, stage, round((epoch_us(c) - epoch_us(coalesce(s, start_ts))) / 1e6, 3) AS seconds, s IS NULL AS from_run_start
FROM p JOIN ({{days}}) USING (run_id) WHERE c IS NOT NULL

-- name: metrics_last
SELECT run_id, name, arg_max(value, (ts, seq)) AS value FROM ({{marks}}) GROUP BY run_id, name

-- name: metrics_merge
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra=' || event_id || ';type=' || event_type || ';user=own' ELSE 'type=' || event_type || ';user=' || user_id END AS merged FROM events

-- name: error_rates
WITH c AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS period_start, error_category, count(*) AS n_errors FROM ({{categories}}) WHERE error_category IS NOT NULL GROUP BY ALL)
SELECT *, round(n_errors / sum(n_errors) OVER (PARTITION BY period_start), 6) AS share FROM c

-- name: top_errors
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, error_category, event_type AS function, 'user ' || user_id % 50 || ': ' || error_message AS message, count(*) AS n
  FROM ({{categories}}) WHERE error_category IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY day, error_category ORDER BY n DESC, function, message)::INTEGER AS rank FROM c QUALIFY rank <= 5
