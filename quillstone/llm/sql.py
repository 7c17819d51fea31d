"""DuckDB SQL of the operators that SQL can express."""

REVISITS = r"""
WITH p AS (
  SELECT page_id AS page, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages
), c AS (
  SELECT *, k, (k = 0 AND page % 7 <> 3) OR (k = 2 AND page % 2 = 0) AS is_full,
         'W/"' || digest[1:8] || CASE WHEN page % 5 = 0 AND k > 0 THEN '-x' ELSE '' END || '"' AS tag,
         1700000000 + k * 86400 + (page * 7919) % 80000 AS ts
  FROM p, (VALUES (0), (1), (2)) AS v(k)
), u AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM c
), r AS (
  SELECT page * 3 + k AS record_id, CASE WHEN is_full THEN 'response' ELSE 'revisit' END AS record_type, ts, is_full, digest,
         CASE WHEN NOT is_full AND page % 11 = 0 THEN NULL ELSE regexp_replace(tag, '^W/', '') END AS validator,
         CASE WHEN is_full THEN MAP {'etag': tag, 'content-length': CAST(size AS VARCHAR), 'date': CAST(ts AS VARCHAR), 'server': 'a'}
              WHEN page % 11 = 0 THEN MAP {'date': CAST(ts AS VARCHAR), 'server': 'b'}
              ELSE MAP {'etag': tag, 'date': CAST(ts AS VARCHAR), 'cache-control': 'max-age=60', 'content-length': '0'} END AS h,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+', '/', 'g') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|sessionid|ref)(=|$)'))) AS q
  FROM u
), n AS (
  SELECT *, host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE '/' END
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM r
), w AS (
  SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM n
), j AS (
  SELECT w.*, b.record_id AS base, b.h AS bh, b.digest AS base_digest, (w.validator = b.validator) AS same
  FROM w LEFT JOIN n b ON b.record_id = w.near
), o AS (
  SELECT *, CASE WHEN record_type = 'response' THEN 'response' WHEN base IS NULL THEN 'orphan' WHEN same IS NULL THEN 'unverified'
                 WHEN same THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM j
), m AS (
  SELECT *, outcome = 'resolved' AS ok,
         list_filter(map_entries(h), lambda e: e.key IN ('age', 'cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')) AS upd FROM o
)
SELECT record_id, record_type, canonical_url, ts AS ts_seconds, outcome,
       CASE WHEN outcome = 'response' THEN record_id WHEN ok THEN base END AS refers_to,
       array_to_string(list_sort(list_transform(
         CASE WHEN ok THEN list_concat(list_filter(map_entries(bh), lambda e: NOT list_contains(list_transform(upd, lambda z: z.key), e.key)), upd) ELSE map_entries(h) END,
         lambda e: e.key || ': ' || e.value)), chr(10)) AS header_lines,
       CASE WHEN outcome = 'response' THEN digest WHEN ok THEN base_digest END AS payload_digest
FROM m
"""

ORACLES = {"op1_revisits": REVISITS}
