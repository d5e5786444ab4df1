-- part: notifications
SELECT doc_id AS event_id, source, lang, n_chars, doc_id % 3 AS last,
  CASE WHEN doc_id % 13 = 0 THEN 'records_missing' WHEN doc_id % 17 = 0 THEN 'records_empty'
       WHEN doc_id % 19 = 0 THEN 'records_not_a_list'
       WHEN doc_id % 11 = 0 AND doc_id % 3 = 0 THEN 'event_source'
       WHEN doc_id % 23 = 0 THEN 'bucket' WHEN doc_id % 11 = 0 THEN 'event_source' END AS reason
FROM documents

-- name: event_records
WITH n AS ({{notifications}})
SELECT event_id, i::INTEGER AS pos, source AS bucket,
       'folder/' || event_id || ' ' || lang || ' ' || i || '.html' AS key
FROM n, unnest(range(last + 1)) AS u(i) WHERE reason IS NULL

-- name: event_rejects
SELECT event_id, reason AS reject_reason FROM ({{notifications}}) WHERE reason IS NOT NULL

-- name: trigger_response
SELECT event_id, CASE WHEN reason IS NULL THEN 200 ELSE 400 END::INTEGER AS status_code,
  CASE WHEN reason IS NULL THEN 'S3 event processing completed successfully' ELSE 'S3 event processing failed' END AS message,
  CASE WHEN reason IS NULL THEN last + 1 ELSE 0 END::INTEGER AS processed_records,
  round(n_chars / 1024.0::DOUBLE, 2) AS execution_time,
  CASE WHEN reason IS NULL THEN array_to_string(list_transform(range(last + 1),
    lambda i: source || '/folder/' || event_id || ' ' || lang || ' ' || i || '.html'), '|') END AS results
FROM ({{notifications}})

-- name: raw_object_decode
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN '  ' || chr(10) ELSE text END AS t FROM documents)
SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS digest,
  CASE WHEN NOT regexp_matches(t, '[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]') THEN 'blank' END AS reject_reason
FROM t

-- name: object_errors
WITH c AS (SELECT event_id, ['NoSuchKey','NoSuchBucket','AccessDenied','SlowDown'][floor(value)::BIGINT % 4 + 1] AS error_code FROM events)
SELECT event_id, error_code,
  CASE error_code WHEN 'NoSuchKey' THEN 'object not found' WHEN 'NoSuchBucket' THEN 'bucket not found'
    WHEN 'AccessDenied' THEN 'access denied' ELSE 'storage error' END AS reason,
  CASE error_code WHEN 'NoSuchKey' THEN 'input_validation' WHEN 'NoSuchBucket' THEN 'configuration'
    WHEN 'AccessDenied' THEN 'authentication' ELSE 'external_service' END AS category
FROM c

-- name: execution_input
SELECT doc_id, md5(text) AS digest, 1704067200 + doc_id * 61 AS timestamp, 's3_event' AS origin, source AS bucket, doc_id::VARCHAR AS key
FROM documents

-- name: stream_ingest
SELECT doc_id, source || '/' || doc_id AS path, md5(text) AS digest,
  CASE WHEN NOT regexp_matches(text, '[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]') THEN 'blank' END AS reject_reason
FROM documents

-- name: stream_objects
WITH n AS ({{notifications}}),
r AS (SELECT event_id, source AS bucket, 'folder/' || event_id || ' ' || lang || ' ' || i || '.html' AS key FROM n, unnest(range(last + 1)) AS u(i) WHERE reason IS NULL),
t AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN '  ' || chr(10) ELSE text END AS t FROM documents)
SELECT bucket, key, length(t)::INTEGER AS n, md5(t) AS digest,
  CASE WHEN NOT regexp_matches(t, '[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]') THEN 'blank' END AS reject_reason
FROM r JOIN t ON doc_id = event_id

-- name: stream_dedup
SELECT event_id, user_id, event_type FROM events

-- name: payload_normalize
WITH p AS (
  SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'missing' WHEN conv_id % 11 = 0 OR conv_id % 13 = 0 THEN 'empty'
    WHEN conv_id % 17 = 0 THEN 'invalid' END AS reason FROM conversations),
q AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN conv_id % 19 = 0 THEN '{"zeta":' || turn || ',"alpha":[{"y":1,"x":2}]}'
    WHEN turn % 5 = 0 AND text = '' THEN 'x' ELSE text END AS content FROM p)
SELECT conv_id, turn, md5(content) AS digest, reason AS reject_reason FROM q

-- part: seeds
SELECT *, CASE WHEN kind IN (2, 3) THEN 0 ELSE len(seeds) + email_id % 7 END AS n_articles
FROM (
  SELECT doc_id AS email_id, source, doc_id % 6 AS kind,
    ['articles','sections','none','malformed','long_title','unicode'][doc_id % 6 + 1] AS variant,
    ['quoted-printable','base64','7bit'][(doc_id // 6) % 3 + 1] AS encoding,
    CASE WHEN len(s) > 0 THEN s ELSE ['A document without a full sentence.'] END AS seeds
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
    lambda x: trim(regexp_replace(x, '[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents))

-- part: mail_articles
SELECT email_id, source, kind, variant, n_articles, i,
  seeds[(i % len(seeds)) + 1] || ' / no. ' || (i + 1) AS title,
  'https://medium.com/@' || source || '/doc' || email_id || '-' || (i % len(seeds)) || '-no-' || (i + 1) AS url,
  seeds[(i % len(seeds)) + 1] AS content, 'Writer ' || source AS author
FROM ({{seeds}}), unnest(range(n_articles)) AS u(i)

-- part: mails
SELECT s.email_id, s.variant, s.encoding, s.n_articles, s.kind,
  '<html><head><title>Morning issue</title></head><body><div class="issue"><h1>Issue of the day</h1>' || chr(10)
  || CASE s.kind WHEN 2 THEN '<p>Nothing new in this issue.</p>'
     WHEN 3 THEN '<p>More on <a href=''no-address-here''>another page</a> soon.</p>'
     WHEN 1 THEN '<div class="part"><div class="head"><h2>Today&#x27;s highlights</h2></div><table>' || chr(10) || coalesce(a.first, '')
       || '</table></div>' || chr(10) || '<div class="part"><div class="head"><h2>From your following</h2></div><table>' || chr(10)
       || coalesce(a.second, '') || '</table></div>' || chr(10)
     ELSE a.items END
  || '<footer><p>Until the next issue.</p></footer></div></body></html>' AS html,
  'Morning issue' || chr(10) || chr(10) || coalesce(a.listing, 'Nothing new in this issue.' || chr(10)) AS text
FROM ({{seeds}}) s LEFT JOIN (
  SELECT email_id,
    string_agg('<div class="entry"><h3><a href="' || url || '">' ||
      CASE kind WHEN 4 THEN repeat(et || ': a long survey ', 3) WHEN 5 THEN 'Many scripts at once: ελληνικά, 한국어, हिन्दी, עברית' ELSE et END
      || '</a></h3>' || chr(10) || '<blockquote>' || ec || '</blockquote></div>' || chr(10), '' ORDER BY i) AS items,
    string_agg(row_html, '' ORDER BY i) FILTER (WHERE i < ceil(n_articles / 2.0)) AS first,
    string_agg(row_html, '' ORDER BY i) FILTER (WHERE i >= ceil(n_articles / 2.0)) AS second,
    string_agg('* ' || title || chr(10) || '  ' || url || chr(10), chr(10) ORDER BY i) AS listing
  FROM (
    SELECT *, '<tr><td><h3><a href="' || url || '?source=email-digest">' || et || '</a></h3>' || chr(10) || '<p>by ' || author
      || ' in Weekly Notes, 5 min</p></td></tr>' || chr(10) AS row_html
    FROM (SELECT *, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS et,
      replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS ec
      FROM ({{mail_articles}})))
  GROUP BY email_id) a ON a.email_id = s.email_id

-- name: newsletter_emails
SELECT email_id, variant, encoding, n_articles::INTEGER AS n_articles, length(html)::INTEGER AS n, md5(html) AS digest, md5(text) AS text_digest
FROM ({{mails}})

-- name: mime_html_part
SELECT email_id, variant, 'text/html' AS content_type, encoding, length(html)::INTEGER AS n, md5(html) AS digest FROM ({{mails}})

-- part: section_rows
SELECT email_id, CASE WHEN i < ceil(n_articles / 2.0) THEN 'highlights' ELSE 'following' END AS section,
  CASE WHEN i < ceil(n_articles / 2.0) THEN 0 ELSE 1 END::INTEGER AS section_rank, url, title,
  CASE WHEN length(name) > 2 AND length(name) < 50 THEN name WHEN at_name <> '' THEN at_name ELSE 'Unknown Author' END AS author
FROM (
  SELECT *, regexp_replace(trim(regexp_extract(block, '(?i)by\s+([^,\n|]+)', 1), E' \t\n\r\x0b\x0c'), '(?i)\s+in\s+.*$', '') AS name,
    regexp_extract(block, '@([\w\-\.]+)', 1) AS at_name
  FROM (SELECT *, title || chr(10) || 'by ' || author || ' in Weekly Notes, 5 min' AS block FROM ({{mail_articles}}) WHERE kind = 1))
WHERE length(title) > 10

-- name: section_links
SELECT * FROM ({{section_rows}})

-- name: section_union_fallback
WITH s AS ({{section_rows}}),
g AS (
  SELECT email_id, 'general' AS section, 2::INTEGER AS section_rank, url, t AS title,
    CASE WHEN length(name) > 2 AND length(name) < 50 THEN name ELSE 'Unknown Author' END AS author
  FROM (
    SELECT *, trim(regexp_extract(h, '(?i)by\s+([^,\n|]+)', 1), E' \t\n\r\x0b\x0c') AS name
    FROM (SELECT *, trim(h) AS t FROM (
      SELECT *, CASE kind WHEN 4 THEN repeat(title || ': a long survey ', 3) WHEN 5 THEN 'Many scripts at once: ελληνικά, 한국어, हिन्दी, עברית' ELSE title END AS h
      FROM ({{mail_articles}}) WHERE kind <> 2 AND kind <> 3))
    WHERE length(t) > 15 AND email_id NOT IN (SELECT email_id FROM s)))
SELECT * FROM s UNION ALL SELECT * FROM g
