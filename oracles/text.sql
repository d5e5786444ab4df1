-- part: titled
SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN source || ' ' || doc_id ELSE '' END AS title, CASE WHEN doc_id % 8 <> 0 THEN text ELSE '' END AS content FROM documents

-- name: required_fields
SELECT doc_id, CASE WHEN title = '' THEN 'title' WHEN content = '' THEN 'content' END AS reject_reason FROM ({{titled}})

-- name: prompt_build
WITH p AS (SELECT doc_id, 'Please provide a concise and informative summary of the following Medium article.' || chr(10) || chr(10) || 'Title: ' || title
  || chr(10) || chr(10) || 'Article Content:' || chr(10) || CASE WHEN length(content) > 3000 THEN left(content, 3000) || '...' ELSE content END
  || chr(10) || chr(10) || 'Instructions:' || chr(10) || '- Create a summary that captures the main points and key insights' || chr(10)
  || '- Keep the summary between 2-4 sentences' || chr(10) || '- Focus on the most important information and takeaways' || chr(10)
  || '- Write in a clear, professional tone' || chr(10) || '- Do not include promotional language or calls to action' || chr(10) || chr(10) || 'Summary:' AS prompt
  FROM ({{titled}}))
SELECT doc_id, length(prompt)::INTEGER AS n, md5(prompt) AS digest FROM p

-- name: summarize
WITH s AS (SELECT doc_id, array_to_string(list_transform(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]+'), 1, 3),
  lambda s: regexp_replace(s, '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+\z', '', 'g')), ' ') AS summary FROM documents)
SELECT doc_id, length(summary)::INTEGER AS n, md5(summary) AS digest FROM s

-- name: response_text
SELECT conv_id, turn, md5(CASE WHEN turn % 5 = 0 THEN regexp_replace(text, '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+\z', '', 'g') ELSE '' END) AS digest
FROM conversations

-- name: fallback_summary
WITH r AS (SELECT doc_id, title, doc_id % 7 = 0 AS failed, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN NULL ELSE content END AS s FROM ({{titled}})),
k AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN s IS NULL OR NOT regexp_matches(s, '[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]') THEN 'fallback' ELSE 'model' END AS summary_source FROM r)
SELECT doc_id, CASE summary_source WHEN 'failed' THEN 'Summary could not be generated due to processing error'
  WHEN 'fallback' THEN 'Summary unavailable for ''' || title || '''. The article content could not be processed at this time.' ELSE s END AS summary, summary_source FROM k

-- name: service_error_class
WITH c AS (SELECT event_id, ['ThrottlingException','ServiceUnavailableException','InternalServerException','ValidationException','AccessDeniedException','SomethingElse'][floor(value)::BIGINT % 6 + 1] AS error_code FROM events)
SELECT event_id, error_code, CASE WHEN error_code IN ('ValidationException','AccessDeniedException') THEN 'fatal' ELSE 'retryable' END AS error_class FROM c

-- name: slim_projection
SELECT 'u' || doc_id AS url, source || ' ' || doc_id AS title, lang AS author, text AS summary FROM documents

-- part: message_inputs
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source || ' *' || doc_id || '*' END AS title,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE nullif((SELECT {{strip}} FROM (SELECT text AS x)), '') END AS summary,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'https://example.org/' || doc_id % 50 END AS url FROM documents

-- part: made_messages
SELECT *, CASE WHEN title IS NULL THEN 'title' WHEN summary IS NULL THEN 'summary' WHEN url IS NULL THEN 'url' END AS reject_reason,
  '📌 *' || title || '*' || chr(10) || chr(10) || '📝 ' || summary || chr(10) || chr(10) || '🔗 link：' || url AS message FROM ({{message_inputs}})

-- name: article_message
SELECT doc_id, message, reject_reason FROM ({{made_messages}})

-- name: message_payload
SELECT doc_id, '{"summary":"note ' || doc_id || ' ' || source || ' 🔗："}' AS payload, strlen('{"summary":"note ' || doc_id || ' ' || source || ' 🔗："}') AS payload_bytes FROM documents

-- name: delivery_class
SELECT page_id, status, CASE WHEN status = 200 THEN 'ok' WHEN status IS NULL OR status = 429 OR status >= 500 THEN 'retryable' ELSE 'fatal' END AS delivery,
  CASE WHEN status = 200 THEN 'ok' ELSE 'summary_success_slack_failed' END AS item_status FROM ({{statuses}})

-- name: webhook_rule
SELECT page_id, page_id % 7 <> 0 AND url IS NOT NULL AND starts_with(url, 'https://') AS allowed FROM pages

-- name: article_input
SELECT doc_id, CASE WHEN bare THEN '' ELSE 'https://example.org/' || doc_id END AS url, CASE WHEN bare OR doc_id % 3 = 0 THEN '' ELSE source END AS title,
  md5(CASE WHEN bare THEN '' ELSE coalesce(text, '') END) AS digest
FROM (SELECT *, doc_id % 5 <> 0 AND doc_id % 7 = 0 AS bare FROM documents)

-- name: message_sink
SELECT DISTINCT sha256(url || message) AS message_key, url, md5(message) AS digest FROM ({{made_messages}}) WHERE message IS NOT NULL

-- name: stream_messages
SELECT DISTINCT sha256(url || message) AS message_key, url, md5(message) AS digest FROM ({{made_messages}}) WHERE message IS NOT NULL

-- name: run_outcome
WITH i AS (SELECT source AS run_id, doc_id % 3 <> 0 AND source <> 'src3' AS f, doc_id % 4 <> 0 AS s, doc_id % 5 <> 0 AS d FROM documents),
c AS (SELECT run_id, count(*) AS total_links, count(*) FILTER (WHERE f) AS fetched, count(*) FILTER (WHERE f AND s) AS summarised, count(*) FILTER (WHERE f AND s AND d) AS delivered FROM i GROUP BY run_id),
r AS (SELECT DISTINCT unnest([source, 'none-' || source]) AS run_id FROM documents),
o AS (SELECT r.run_id, coalesce(total_links, 0) AS total_links, coalesce(fetched, 0) AS fetched, coalesce(summarised, 0) AS summarised, coalesce(delivered, 0) AS delivered,
  CASE WHEN r.run_id IN ('src4', 'none-src5') THEN 'parse_error' WHEN total_links IS NULL THEN 'no_links' WHEN r.run_id = 'src6' THEN 'fetch_error'
    WHEN fetched = 0 THEN 'none_fetched' WHEN r.run_id = 'src7' THEN 'summarize_error' ELSE 'complete' END AS outcome
  FROM r LEFT JOIN c ON c.run_id = r.run_id)
SELECT *, CASE outcome WHEN 'parse_error' THEN 400 WHEN 'none_fetched' THEN 206 WHEN 'fetch_error' THEN 500 WHEN 'summarize_error' THEN 500 ELSE 200 END::INTEGER AS status_code,
  CASE outcome WHEN 'parse_error' THEN 'Failed to parse email content' WHEN 'no_links' THEN 'No articles found in email content'
    WHEN 'fetch_error' THEN 'Critical error during article fetching' WHEN 'none_fetched' THEN 'No articles could be fetched successfully'
    WHEN 'summarize_error' THEN 'Critical error during article summarization' ELSE 'Processing completed successfully' END AS message,
  CASE WHEN outcome = 'complete' THEN fetched ELSE 0 END AS articles_processed,
  CASE WHEN outcome = 'none_fetched' THEN 'All article fetch attempts failed' END AS error
FROM o

-- part: failing_items
SELECT source AS run_id, ['ok','ok','failed','failed_summary','summary_success_slack_failed',NULL][doc_id % 6 + 1] AS item_status, 'error ' || doc_id % 4 AS error FROM documents

-- name: partial_failures
SELECT run_id, count(*) FILTER (WHERE item_status = 'ok') AS ok, count(*) FILTER (WHERE item_status = 'failed') AS failed,
  count(*) FILTER (WHERE item_status = 'failed_summary') AS failed_summary, count(*) FILTER (WHERE item_status = 'summary_success_slack_failed') AS summary_success_slack_failed,
  count(*) FILTER (WHERE item_status IS DISTINCT FROM 'ok') AS n_failed, count(*) AS n_items FROM ({{failing_items}}) GROUP BY run_id

-- name: partial_failure_errors
SELECT run_id, item_status, error, count(*) AS n FROM ({{failing_items}}) WHERE item_status IS DISTINCT FROM 'ok' GROUP BY ALL

-- name: result_response
WITH g AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS c, min(doc_id) AS m FROM documents GROUP BY source)
SELECT source, CASE WHEN m % 2 = 0 THEN 200 ELSE 500 END::INTEGER AS status_code, CASE WHEN m % 2 = 0 THEN 'Processing completed' ELSE 'Processing failed' END AS message,
  n AS articles, CASE WHEN m % 2 = 0 THEN '[]' ELSE '["late","lost"]' END AS errors, round(c / 1024.0::DOUBLE, 6) AS seconds FROM g

-- name: error_response
WITH k AS (SELECT event_id, event_type, user_id, ['validation','authentication','fetch','fatal','other'][event_id % 5 + 1] AS kind FROM events)
SELECT event_id, kind, CASE kind WHEN 'validation' THEN 400 WHEN 'authentication' THEN 401 ELSE 500 END::INTEGER AS status_code,
  CASE kind WHEN 'validation' THEN 'Validation error' WHEN 'authentication' THEN 'Authentication error' WHEN 'fetch' THEN 'Fetch error' ELSE 'Internal server error' END AS error_name,
  CASE WHEN kind = 'authentication' THEN 'Failed to authenticate with Medium' WHEN kind IN ('validation', 'fetch') THEN 'user ' || user_id
    ELSE 'Fatal error in ' || event_type || ': user ' || user_id END AS error_message,
  CASE WHEN kind IN ('fatal', 'other') THEN event_type END AS error_context FROM k

-- name: retry_schedule
WITH p(i, policy, n, base, cap) AS (VALUES (0, 'article', 3, 1, 60), (1, 'model', 3, 2, 60), (2, 'webhook', 3, 1, 60), (3, 'parse_service', 3, 2, NULL), (4, 'parse_task', 2, 1, NULL),
  (5, 'fetch_service', 3, 2, NULL), (6, 'fetch_task', 5, 10, NULL), (7, 'summarize_service', 3, 3, NULL), (8, 'summarize_task', 2, 5, NULL), (9, 'deliver_service', 3, 2, NULL), (10, 'deliver_task', 3, 1, NULL)),
d AS (SELECT event_id, policy, list_transform(range(n), lambda k: least(base * (2 ** k), coalesce(cap, 1000000000))::INTEGER) AS ds FROM events JOIN p ON p.i = floor(value)::BIGINT % 11)
SELECT event_id, policy, array_to_string(ds, ',') AS delays, list_sum(ds)::DOUBLE AS total_wait FROM d

-- name: retry_outcome
WITH l AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS request_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS n,
  CASE event_type WHEN 'error' THEN 'NetworkError' WHEN 'view' THEN 'ValueError' WHEN 'purchase' THEN 'RateLimitError' WHEN 'signup' THEN 'ValidationError' END AS e FROM events),
s AS (SELECT request_id, min(n) FILTER (WHERE e IS NULL OR e = 'ValidationError' OR (e = 'ValueError' AND n > 1) OR n > 3) AS stop, least(max(n), 4) AS last FROM l WHERE n <= 4 GROUP BY request_id),
f AS (SELECT s.*, l.e, l.n FROM s JOIN l ON l.request_id = s.request_id AND l.n = coalesce(s.stop, s.last))
SELECT request_id, CASE WHEN stop IS NULL THEN 'pending' WHEN e IS NULL THEN 'success' ELSE 'failed' END AS status, n::INTEGER AS attempts, e AS last_error,
  ((2 ** (n - 1)) - 1)::DOUBLE AS waited FROM f
