-- part: text_of
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')

-- name: html_nodes
SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<a ')) AS n_a,
  len(regexp_extract_all(html, '<li>')) AS n_li, len(regexp_extract_all(html, '<h1>')) AS n_h1,
  (SELECT {{text_of}} FROM (SELECT trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS x)) AS heading
FROM pages

-- part: all_tokens
SELECT page_id, i, regexp_extract(tok, '^</?([a-z0-9]+)', 1) AS tag, tok NOT LIKE '</%' AS opens
FROM (SELECT page_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tok FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(script|style)>).*?</', '\1</', 'g'), '</?[a-z][^>]*>') AS t FROM pages))

-- name: node_pairs
WITH t AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY i) AS depth,
    sum(opens::INTEGER) OVER (PARTITION BY page_id ORDER BY i) - 1 AS node_id FROM ({{all_tokens}})),
own AS (SELECT o.page_id, o.i, o.tag, o.node_id, coalesce(min(c.i), 1000000000) AS e FROM t o
  LEFT JOIN t c ON c.page_id = o.page_id AND c.tag = o.tag AND NOT c.opens AND c.i > o.i AND c.depth < o.depth
  WHERE o.opens AND o.tag IN ('html', 'head', 'body', 'nav', 'ul', 'li', 'article', 'div', 'footer', 'p') GROUP BY ALL),
a AS (SELECT o.page_id, o.i, o.tag, o.node_id, min(w.e) AS e FROM own o JOIN own w ON w.page_id = o.page_id AND w.i <= o.i AND w.e > o.i GROUP BY ALL)
SELECT a.page_id, a.node_id::INTEGER AS ancestor_id, a.tag AS ancestor_tag, d.node_id::INTEGER AS node_id, d.tag AS tag
FROM a JOIN t d ON d.page_id = a.page_id AND d.opens AND d.i > a.i AND d.i < a.e AND d.tag IN ('p', 'a', 'li', 'h1', 'b')

-- name: strip_boilerplate
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g'),
  '(?is)<header\b.*?</header>', '', 'g'), '(?is)<footer\b.*?</footer>', '', 'g'), '(?is)<aside\b.*?</aside>', '', 'g') AS t FROM pages)
SELECT page_id, length(t)::INTEGER AS n, md5(t) AS digest FROM s

-- part: clean
trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')), 'Follow *\z', ''), 'Sign up *\z', ''), 'Sign in *\z', ''))

-- part: titles
SELECT page_id, (SELECT {{clean}} FROM (SELECT coalesce(CASE WHEN length(h) > 5 THEN h END, CASE WHEN length(t) > 5 THEN t END) AS x)) AS title
FROM (SELECT page_id,
  (SELECT {{text_of}} FROM (SELECT trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS x)) AS h,
  (SELECT {{text_of}} FROM (SELECT trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS x)) AS t FROM pages)

-- name: page_title
SELECT * FROM ({{titles}})

-- part: tokens
SELECT page_id, i, tok, sum(CASE WHEN tok IN ('<p>', '<h1>') THEN 1 WHEN tok IN ('</p>', '</h1>') THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY i) AS depth,
  CASE WHEN tok LIKE '<%' THEN NULL ELSE (SELECT {{text_of}} FROM (SELECT tok AS x)) END AS txt
FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tok FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<[^>]*>|[^<]+') AS t FROM pages))

-- part: blocks
SELECT o.page_id, o.i, coalesce(min(c.i), 1000000) AS e, o.tok FROM t o
LEFT JOIN t c ON c.page_id = o.page_id AND c.i > o.i AND c.tok IN ('</p>', '</h1>') AND c.depth = o.depth - 1
WHERE o.tok IN ('<p>', '<h1>') GROUP BY o.page_id, o.i, o.tok

-- part: joined
SELECT page_id, string_agg((SELECT {{clean}} FROM (SELECT s AS x)), chr(10) || chr(10) ORDER BY i) FILTER (WHERE length(s) > 5) AS all_blocks,
  string_agg((SELECT {{clean}} FROM (SELECT s AS x)), chr(10) || chr(10) ORDER BY i) FILTER (WHERE length(s) > 20 AND tok = '<p>') AS paragraphs
FROM (SELECT b.page_id, b.i, b.tok, coalesce(string_agg(trim(x.txt, E' \t\n\r'), '' ORDER BY x.i), '') AS s
  FROM b LEFT JOIN t x ON x.page_id = b.page_id AND x.i > b.i AND x.i < b.e AND x.txt IS NOT NULL GROUP BY b.page_id, b.i, b.tok)
GROUP BY page_id

-- part: contents
WITH t AS ({{tokens}}), b AS ({{blocks}}), j AS ({{joined}})
SELECT p.page_id, CASE WHEN length(all_blocks) > 100 THEN all_blocks ELSE paragraphs END AS content
FROM pages p LEFT JOIN j ON j.page_id = p.page_id

-- part: contents_once
WITH t AS ({{tokens}}), b0 AS ({{blocks}}),
b AS (SELECT * FROM b0 o WHERE NOT EXISTS (SELECT 1 FROM b0 x WHERE x.page_id = o.page_id AND x.i > o.i AND x.i < o.e)),
j AS ({{joined}})
SELECT p.page_id, CASE WHEN length(all_blocks) > 100 THEN all_blocks ELSE paragraphs END AS content
FROM pages p LEFT JOIN j ON j.page_id = p.page_id

-- name: page_content
SELECT page_id, length(content)::INTEGER AS n, md5(content) AS digest FROM ({{contents}})

-- name: page_content_once
SELECT page_id, length(content)::INTEGER AS n, md5(content) AS digest FROM ({{contents_once}})

-- name: page_article
SELECT p.page_id, p.url, t.title, length(t.title)::INTEGER AS title_len, length(c.content)::INTEGER AS content_len, md5(c.content) AS digest,
  CASE WHEN t.title IS NULL THEN 'no_title' WHEN c.content IS NULL THEN 'no_content' END AS reject_reason
FROM pages p JOIN ({{titles}}) t ON t.page_id = p.page_id JOIN ({{contents}}) c ON c.page_id = p.page_id

-- name: clean_text
WITH c AS (SELECT doc_id, (SELECT {{clean}} FROM (SELECT text || ['', ' Follow', 'Sign up ', ' Sign in'][doc_id % 4 + 1] AS x)) AS t FROM documents)
SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS digest FROM c

-- part: page_anchors
SELECT page_id, url, i::INTEGER AS pos, h[i + 1] AS href, (SELECT {{text_of}} FROM (SELECT trim(y[i + 1]) AS x)) AS text
FROM (SELECT page_id, url, h, x AS y, unnest(range(len(h))) AS i FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h,
    regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS x FROM pages))

-- name: anchors
SELECT page_id, pos, (SELECT {{text_of}} FROM (SELECT href AS x)) AS href, text FROM ({{page_anchors}})

-- name: first_seen_dedup
SELECT host, href, page_id, pos, text FROM (
  SELECT *, row_number() OVER (PARTITION BY host, href ORDER BY page_id, pos) AS rn FROM (
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, href, page_id, i::INTEGER AS pos, x[i + 1] AS text
    FROM (SELECT page_id, url, h[i + 1] AS href, x, i FROM (SELECT page_id, url, h, x, unnest(range(len(h))) AS i FROM (
      SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h,
        regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS x FROM pages)))))
WHERE rn = 1

-- name: link_filter
SELECT page_id, url FROM pages
WHERE NOT regexp_matches(url, '(?i)cheap-pills|spam-farm|\.html$') AND regexp_matches(url, '(?i)/[a-z]{2}/\d+')

-- part: host_rules
SELECT 'skip' AS kind, '//' || upper(host) || '/' AS rule, host FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)
WHERE host <> '' AND (starts_with(host, 'www.') OR contains(host, '-'))
UNION ALL SELECT 'accept', host || '/[a-z]{2}/\d+\?', host FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) WHERE host <> ''

-- part: ruled
SELECT page_id, url, (SELECT min(rule) FROM r WHERE kind = 'skip' AND contains(lower(url), '//' || lower(host) || '/')) AS skip_rule,
  (SELECT min(rule) FROM r WHERE kind = 'accept' AND regexp_matches(url, '(?i)' || replace(host, '.', '\.') || '/[a-z]{2}/\d+\?')) AS accept_rule FROM pages

-- name: link_rules
WITH r AS ({{host_rules}}) {{ruled}}

-- name: link_filter_by_table
WITH r AS ({{host_rules}}) SELECT page_id, url FROM ({{ruled}}) WHERE skip_rule IS NULL AND accept_rule IS NOT NULL

-- part: canonical
SELECT k, head || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (
  SELECT k, head, array_to_string(list_transform(list_filter(range(1, len(ks) + 1), lambda i: list_position(ks, ks[i]) = i),
      lambda i: ks[i] || '=' || array_to_string(list_transform(list_filter(range(1, len(ks) + 1), lambda j: ks[j] = ks[i]), lambda j: vs[j]), '&')), '&') AS q
  FROM (
    SELECT k, head, list_transform(ps, lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' '))) AS ks,
      list_transform(ps, lambda p: url_decode(replace(p[strpos(p, '=') + 1:], '+', ' '))) AS vs
    FROM (
      SELECT k, lower(regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) || '://' ||
        regexp_replace(regexp_replace(base, '^[a-zA-Z][a-zA-Z0-9+.\-]*:', ''), '^//', '') AS head,
        list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND
          lower(split_part(p, '=', 1)) NOT IN ('source','utm_source','utm_medium','utm_campaign','utm_content','utm_term','ref','referrer')) AS ps
      FROM (SELECT k, split_part(u, '?', 1) AS base, CASE WHEN strpos(u, '?') > 0 THEN u[strpos(u, '?') + 1:] ELSE '' END AS query
        FROM (SELECT k, split_part(url, '#', 1) AS u FROM raw)))))

-- name: url_canonicalize
WITH raw AS (
  SELECT page_id AS k, CASE WHEN x = '' THEN url ELSE split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || x || '#end' END AS url
  FROM (SELECT page_id, url, ['', 'utm_medium=mail&id=5&b=', 'q=a%20b&REF=z&c=1+2', 'a=1&a=2&a=&d=4'][page_id % 4 + 1] AS x FROM pages))
SELECT k AS page_id, url FROM ({{canonical}})

-- name: url_allowlist
WITH s AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE WHEN scheme <> 'https' THEN 'scheme'
  WHEN host NOT IN ('blog.example.com', 'm.example.net') AND NOT ends_with(host, '.example.org') THEN 'domain'
  WHEN length(path) <= 1 THEN 'path' END AS reason FROM s)
SELECT page_id, url, reason IS NULL AS valid, reason FROM j

-- part: strip
regexp_replace(x, '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+\z', '', 'g')

-- name: link_title
WITH d AS (
  SELECT doc_id, own, CASE WHEN doc_id % 5 = 0 THEN own || chr(10) || ' by someone else entirely' || chr(10) || text ELSE 'short' END AS up,
    CASE WHEN doc_id % 3 = 0 THEN 'A heading above' END AS h1, CASE WHEN doc_id % 2 = 0 THEN 'Another heading' END AS h2
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'Read more' ELSE text END AS own FROM documents)),
g AS (SELECT *, CASE WHEN length(own) > 15 AND NOT regexp_matches(own, '(?i)^(read\s+more|continue\s+reading|view\s+story|medium\.com)$') THEN own ELSE '' END AS general_title FROM d)
SELECT doc_id, coalesce(nullif(general_title, ''),
  list_filter(list_transform(string_split(up, chr(10)), lambda l: regexp_replace(l, '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+\z', '', 'g')),
    lambda l: length(l) > 15 AND l <> own AND NOT regexp_matches(l, '(?i)^(by\s+|@|read\s+more)'))[1], h1, h2, '') AS title, general_title
FROM g

-- name: link_author
WITH d AS (SELECT doc_id, ['by Jane Roe in Some Pub, 5 min ', 'By  Ana|', '@handle_1.x ', ''][doc_id % 4 + 1] || text AS block,
  CASE WHEN doc_id % 10 = 0 THEN 'Profile Name' END AS profile FROM documents),
n AS (SELECT *, (SELECT {{strip}} FROM (SELECT regexp_extract(block, '(?i)by\s+([^,\n|]+)', 1) AS x)) AS long_name FROM d),
c AS (SELECT *, regexp_replace(long_name, '(?i)\s+in\s+.*$', '') AS name FROM n)
SELECT doc_id, coalesce(profile, CASE WHEN length(name) > 2 AND length(name) < 50 THEN name END,
    nullif(regexp_extract(block, '@([\w\-\.]+)', 1), ''), '') AS author,
  CASE WHEN length(long_name) > 2 AND length(long_name) < 50 THEN long_name ELSE '' END AS general_author
FROM c

-- name: article_defaults
SELECT doc_id, 'u' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || '-' || doc_id END AS title,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '' END AS content, '' AS summary, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS author
FROM documents

-- part: statuses
SELECT page_id, [200, 200, 429, 401, 403, 500, 503, 404, 301, NULL][(length(html) % 17) % 10 + 1]::INTEGER AS status FROM pages

-- name: response_class
SELECT page_id, status,
  CASE WHEN status IS NULL THEN 'network' WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) THEN 'authentication' WHEN status >= 500 THEN 'server' WHEN status <> 200 THEN 'http_error' ELSE 'ok' END AS kind,
  status IS NULL OR (status <> 200 AND status NOT IN (401, 403)) AS retryable,
  CASE WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) THEN 'authentication' WHEN status IS NULL OR status <> 200 THEN 'external_service' END AS category,
  CASE WHEN status = 200 THEN 200 WHEN status IN (401, 403) THEN 401 ELSE 500 END::INTEGER AS stage_status
FROM ({{statuses}})

-- part: link_table
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS run_id,
  CASE WHEN k = 0 THEN url ELSE split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'utm_source=mail&utm_medium=digest' END AS url,
  'author-' || (page_id % 7) AS author, page_id * 2 + k AS pos
FROM pages, (VALUES (0), (1)) AS c(k)

-- name: article_join
WITH l AS (SELECT run_id, author, pos, CASE WHEN pos % 10 = 0 THEN url || '-gone' ELSE url END AS url FROM ({{link_table}})),
raw AS (SELECT pos AS k, url FROM l UNION ALL SELECT -1 - page_id, url FROM pages),
c AS (SELECT k, url FROM ({{canonical}})),
s AS (SELECT c.url, arg_max('v2-' || page_id, page_id) AS title, arg_max(length(html), page_id) AS content FROM pages p JOIN c ON c.k = -1 - p.page_id GROUP BY c.url)
SELECT l.run_id, c.url, l.author, l.pos, s.title, s.content::VARCHAR AS content, s.url IS NOT NULL AS matched
FROM l JOIN c ON c.k = l.pos LEFT JOIN s ON s.url = c.url

-- name: fetch_partition
WITH r AS (SELECT page_id, url, CASE WHEN page_id % 6 <> 0 THEN 't' || page_id END AS title, CASE WHEN page_id % 12 = 0 THEN 'HTTP 500' END AS error FROM pages)
SELECT page_id, url, title, CASE WHEN title IS NULL THEN coalesce(error, 'unknown error') END AS error,
  CASE WHEN title IS NULL THEN 'failed' ELSE 'ok' END AS item_status FROM r

-- part: flow
WITH l AS ({{link_table}}),
raw AS (SELECT pos AS k, url FROM l UNION ALL SELECT -1 - page_id, url FROM pages),
c AS (SELECT k, url FROM ({{canonical}})),
f AS (SELECT run_id, author, pos, url FROM (SELECT l.run_id, l.author, l.pos, c.url, row_number() OVER (PARTITION BY l.run_id, c.url ORDER BY pos) AS rn FROM l JOIN c ON c.k = l.pos) WHERE rn = 1),
a0 AS (SELECT c.url, t.page_id, t.title, array_to_string(list_transform(list_slice(regexp_extract_all(x.content, '[^.!?]+[.!?]+'), 1, 3),
    lambda s: regexp_replace(s, '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+\z', '', 'g')), ' ') AS summary
  FROM ({{titles}}) t JOIN ({{contents}}) x ON x.page_id = t.page_id JOIN c ON c.k = -1 - t.page_id WHERE t.title IS NOT NULL AND x.content IS NOT NULL),
a AS (SELECT url, arg_max(title, page_id) AS title, arg_max(summary, page_id) AS summary FROM a0 GROUP BY url),
m AS (SELECT f.run_id, f.url, f.author, f.pos, a.title, CASE WHEN a.url IS NULL THEN 'failed' ELSE 'ok' END AS item_status,
    CASE WHEN a.summary IS NULL OR NOT regexp_matches(a.summary, '[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]') THEN
      'Summary unavailable for ''' || coalesce(a.title, '') || '''. The article content could not be processed at this time.' ELSE a.summary END AS summary
  FROM f LEFT JOIN a ON a.url = f.url)
SELECT *, CASE WHEN title IS NOT NULL THEN '📌 *' || title || '*' || chr(10) || chr(10) || '📝 ' || summary || chr(10) || chr(10) || '🔗 link：' || url END AS message FROM m

-- name: article_flow
SELECT run_id, url, author, pos, title, md5(summary) AS summary_digest, md5(message) AS digest, item_status FROM ({{flow}})

-- name: article_flow_runs
WITH c AS (SELECT run_id, count(*) AS total_links, count(*) FILTER (WHERE item_status = 'ok') AS fetched FROM ({{flow}}) GROUP BY run_id)
SELECT run_id, total_links, fetched, fetched AS summarised, fetched AS delivered,
  CASE WHEN fetched = 0 THEN 'none_fetched' ELSE 'complete' END AS outcome, CASE WHEN fetched = 0 THEN 206 ELSE 200 END::INTEGER AS status_code,
  CASE WHEN fetched = 0 THEN 'No articles could be fetched successfully' ELSE 'Processing completed successfully' END AS message,
  fetched AS articles_processed, CASE WHEN fetched = 0 THEN 'All article fetch attempts failed' END AS error
FROM c
