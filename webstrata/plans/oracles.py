"""The queries' results in plain SQL over the given tables, for an independent engine."""

from __future__ import annotations

_CALLS = """
calls AS (
  SELECT page_id * 2 AS call_id, 1704067200000 + page_id * 60000 AS ms, 'GET' AS method,
         url AS uri, CAST(NULL AS BLOB) AS req_body,
         CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 302 WHEN 2 THEN NULL ELSE 200 END AS status,
         encode(html) AS resp_body
  FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, 1704067200000 + (page_id + 60) * 60000, 'GET',
         split_part(url, '#', 1) || '#again', NULL, 200, encode(html) FROM pages
  UNION ALL
  SELECT 1000000000 + conv_id * 1000 + turn,
         1704067200000 + 86400000 + (conv_id * 100 + turn) * 1000, 'POST',
         'http://chat.example.com/' || conv_id, encode(text), 200, encode('ok')
  FROM conversations),
keyed AS (
  SELECT *, split_part(uri, '#', 1) AS canonical,
         method || '_' || split_part(uri, '#', 1) AS page_key,
         md5(method || '_' || split_part(uri, '#', 1)) || '_'
           || sha1(method || '_' || split_part(uri, '#', 1))
           || CASE WHEN method = 'POST'
                   THEN '_' || md5(base64(req_body)) || '_' || sha1(base64(req_body))
                   ELSE '' END AS request_key,
         'Content-Type=text/html; charset=utf-8|content-length=' || octet_length(resp_body)
           || CASE WHEN call_id % 7 = 0 THEN '|content-type=application/xhtml+xml' ELSE '' END
           AS headers,
         regexp_extract(uri, '^https?://([^/?#:]+)', 1) AS host
  FROM calls),
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY ms, call_id) AS rn
    FROM keyed WHERE status IS NOT NULL)
  WHERE rn = 1)"""

_LINKS = """
links AS (
  SELECT page_id, url, CAST(k AS INTEGER) AS k, listed[k + 1] AS href, origin,
         origin || array_to_string(list_transform(string_split(listed[k + 1], ''),
           lambda c: CASE WHEN regexp_full_match(c, '[!-~]') THEN c ELSE url_encode(c) END), '')
           AS href_abs,
         '0>1>0>0>' || k || '>0>' AS path, count(*) OVER (PARTITION BY page_id) AS n
  FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+') AS origin,
               regexp_extract_all(html, '<a href="([^"]*)"', 1) AS listed FROM pages),
       unnest(range(len(listed))) AS numbers(k))"""

_SEEDS = """
seed_hosts AS (
  SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS seed
  FROM pages WHERE regexp_matches(url, '^http://[^/]+/es/')),
hosts AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)"""

_VARIANTS = _SEEDS + """,
variants AS (
  SELECT page_id, unnest([host, 'a.b.' || host, 'evil' || host, upper(host)]) AS host
  FROM hosts)"""

_EXTERNAL = r"""((regexp_full_match(host, 'blog\..*') OR regexp_full_match(host, 'm\..*\.com'))
                  AND NOT regexp_full_match(host, '.*\.net'))"""

_SEEDED = """EXISTS (SELECT 1 FROM seed_hosts
                     WHERE host = seed OR ends_with(host, '.' || seed))"""

_STABLE = """
WITH series AS (
  SELECT user_id AS key, event_id AS seq, ts, event_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous
  FROM events),
per_key AS (
  SELECT key, min(CASE WHEN event_type = previous THEN seq END) AS seq,
         arg_min(ts, seq) AS first_ts,
         arg_min(CASE WHEN event_type = previous THEN ts END,
                 CASE WHEN event_type = previous THEN seq END) AS stable_ts
  FROM series GROUP BY key)
"""

_D4 = _STABLE + """
SELECT key, CASE WHEN seq IS NULL THEN 'timed_out' ELSE 'stable' END AS outcome,
       seq AS stable_seq
FROM per_key"""

_ARCHIVED = f"""
WITH {_CALLS}
SELECT uri, status, md5(resp_body) AS payload_md5 FROM keyed WHERE status IS NOT NULL"""

_J1 = f"WITH {_VARIANTS} SELECT page_id, host FROM variants WHERE {_SEEDED}"

ORACLES: dict[str, str] = {
    "s1_seed_source": """
SELECT url, 0 AS clicks, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""",
    "s2_call_source": """
SELECT page_id AS call_id, 'GET' AS method, url AS uri, 200 AS status,
       md5(encode(html)) AS body_md5
FROM pages""",
    "s3_warc_source": f"""
WITH {_CALLS}
SELECT 'request' AS warc_type, uri, ms AS date_ms, method AS http_method,
       CAST(NULL AS INTEGER) AS http_status, md5(coalesce(req_body, encode(''))) AS payload_md5
FROM keyed WHERE status IS NOT NULL
UNION ALL
SELECT 'response', uri, ms, NULL, status, md5(resp_body) FROM keyed WHERE status IS NOT NULL""",
    "s4_warc_sink": f"""
WITH {_CALLS}
SELECT ms AS ts_ms, method, uri, status,
       'Accept-Encoding=gzip|user-agent=probe|Accept=*/*'
         || coalesce('|Content-Length=' || octet_length(req_body), '') AS req_headers,
       md5(coalesce(req_body, encode(''))) AS req_md5, headers AS resp_headers,
       md5(resp_body) AS resp_md5
FROM keyed WHERE status IS NOT NULL""",
    "s5_cdx_index": f"""
WITH {_CALLS}
SELECT array_to_string(list_reverse(string_split(
           regexp_replace(host, '^www[0-9]*\\.', ''), '.')), ',') || ')'
         || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE '/' END
         || CASE WHEN position('?' IN canonical) > 0
                 THEN '?' || array_to_string(list_sort(string_split(
                        lower(split_part(canonical, '?', 2)), '&')), '&')
                 ELSE '' END AS urlkey,
       strftime(make_timestamp(ms * 1000), '%Y%m%d%H%M%S') AS ts, uri AS url,
       CASE WHEN call_id % 7 = 0 THEN 'application/xhtml+xml' ELSE 'text/html' END AS mime,
       CAST(status AS VARCHAR) AS status, '-' AS redirect, '-' AS meta,
       array_to_string(list_transform(range(32), lambda i: substring(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substring(sha, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT)
          & 31)::INT + 1, 1)), '') AS digest,
       TRUE AS has_offset, TRUE AS in_place
FROM (SELECT *, lower(regexp_extract(canonical, '^https?://[^/?#]+([^?#]*)', 1)) AS path,
             sha1(resp_body) AS sha
      FROM keyed WHERE status IS NOT NULL)""",
    "s5_cdx_range_read": _ARCHIVED,
    "s6_call_log": f"""
WITH {_CALLS}
SELECT uri || ' <> ' || status AS line FROM keyed WHERE status IS NOT NULL""",
    "s7_response_store": f"""
WITH {_CALLS}
SELECT request_key, call_id, status, md5(resp_body) AS body_md5 FROM firsts""",
    "s8_response_json": f"""
WITH {_CALLS}
SELECT request_key, status, headers, md5(resp_body) AS body_md5, base64(resp_body) AS content
FROM firsts""",
    "s9_clear_on_init": f"""
WITH {_CALLS}
SELECT 'kept' AS outcome, request_key, call_id FROM firsts
UNION ALL
SELECT 'cleared', request_key, call_id FROM firsts WHERE method = 'POST'""",
    "s10_sink_plugins": f"""
WITH {_CALLS}
SELECT 'store' AS sink, CAST(status AS VARCHAR) AS status, count(*) AS calls
FROM firsts GROUP BY status
UNION ALL
SELECT 'archive', CAST(status AS VARCHAR), count(*) FROM keyed WHERE status IS NOT NULL
GROUP BY status""",
    "p1_canonical_url": "SELECT page_id, split_part(url, '#', 1) AS canonical FROM pages",
    "p1_canonical_escaped": """
SELECT page_id, CAST(form AS INTEGER) AS form,
       [bare || '/A~/b%20c?x=&y++', bare || '/é%25', NULL, NULL, NULL,
        replace(bare, '://', ':/')][form + 1] AS canonical
FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS bare FROM pages),
     unnest(range(6)) AS forms(form)""",
    "p1_sql_functions": f"""
WITH {_CALLS}
SELECT call_id, canonical, host, split_part(uri, ':', 1) AS scheme, page_key, request_key
FROM keyed""",
    "p2_page_key": f"WITH {_CALLS} SELECT call_id, page_key FROM keyed",
    "p3_request_key": f"WITH {_CALLS} SELECT call_id, request_key FROM keyed",
    "p4_host_scheme": f"""
WITH {_CALLS} SELECT call_id, host, split_part(uri, ':', 1) AS scheme FROM keyed""",
    "p5_header_override": f"""
WITH {_CALLS}
SELECT call_id, 'user-agent=probe|Accept=*/*|Accept-Encoding=' AS plain,
       'Accept=*/*|Accept-Encoding=|User-Agent=webstrata-test/1' AS with_agent
FROM keyed""",
    "p6_headers_table": f"""
WITH {_CALLS}
SELECT call_id, CAST(pos AS INTEGER) AS pos, split_part(pair, '=', 1) AS name,
       split_part(pair, '=', 2) || CASE WHEN pos = 0 THEN '=' || split_part(pair, '=', 3)
                                        ELSE '' END AS value
FROM (SELECT call_id, string_split(headers, '|') AS pairs FROM keyed),
     unnest(range(len(pairs))) AS numbers(pos), unnest([pairs[pos + 1]]) AS one(pair)""",
    "p6_flatten_headers": f"""
WITH {_CALLS}
SELECT call_id,
       array_to_string(list_transform(string_split(headers, '|'),
         lambda h: CASE WHEN starts_with(h, 'content-length=') THEN h ELSE h || '|' || h END),
         '|') AS headers
FROM keyed""",
    "p7_content_type": f"""
WITH {_CALLS}
SELECT call_id, CASE WHEN call_id % 7 = 0 THEN 'application/xhtml+xml'
                     ELSE 'text/html; charset=utf-8' END AS content_type,
       CAST(NULL AS VARCHAR) AS sent_type
FROM keyed""",
    "p8_recorded_body": f"""
WITH {_CALLS}
SELECT call_id, CASE WHEN method IN ('POST', 'PUT') THEN md5(req_body) END AS req_md5,
       md5(resp_body) AS resp_md5
FROM keyed""",
    "p9_ref_label": f"""
WITH {_LINKS}
SELECT url || ' @ [' || path || ']' AS label FROM links
UNION ALL
SELECT url || ' @ [0>1>0>0>0>0>] [' || path || ']' FROM links
WHERE k % 2 = 1 AND page_id % 4 <> 0""",
    "p10_resolve_href": f"""
WITH {_LINKS},
parts AS (
  SELECT page_id, k, origin, split_part(url, '#', 1) AS bare, split_part(url, ':', 1) AS scheme,
         substr(href_abs, length(origin) + 1) AS ref, substr(href_abs, length(origin) + 2) AS word,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM links)
SELECT page_id, k AS pos, CAST(form AS INTEGER) AS form,
       [origin || ref,
        origin || regexp_replace(path, '[^/]*$', '') || word,
        origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || word,
        origin || path || '?q=' || word,
        bare || '#' || word,
        scheme || '://other.example.org' || ref,
        'http://other.example.org/a' || ref][form + 1] AS link
FROM parts, unnest(range(7)) AS forms(form)""",
    "x1_clickable_elements": f"""
WITH {_LINKS}
SELECT page_id, url, k AS pos, 'a' AS tag, href, href_abs, 'attribute' AS source FROM links""",
    "x2_submit_elements": """
SELECT page_id, CAST(pos AS INTEGER) AS pos,
       CASE WHEN pos % 2 = 0 THEN 'input' ELSE 'button' END AS tag, 'submit' AS source
FROM (SELECT page_id, len(regexp_extract_all(html, '<h1>')) AS n FROM pages),
     unnest(range(2 * n)) AS numbers(pos)""",
    "x3_listener_elements": f"""
WITH {_LINKS}
SELECT url, k AS pos, path, href_abs AS href, 'listener' AS source
FROM links, unnest(range(2)) AS twice(observation)""",
    "x4_ancestor_path": f"WITH {_LINKS} SELECT page_id, path, 'a' AS tag, href FROM links",
    "x5_path_lookup": f"""
WITH {_LINKS}
SELECT page_id, path, 'a' AS found_tag, path AS found_path FROM links
UNION ALL
SELECT page_id, path || '7>', NULL, NULL FROM links
UNION ALL
SELECT page_id, '0>1>0>0>' || k || '>', 'li', '0>1>0>0>' || k || '>' FROM links""",
    "f1_unwanted_protocols": f"""
WITH {_LINKS}
SELECT page_id, k AS pos, unnest([href, 'MAILTO:' || href, 'javascript:' || href, 'mailto:', NULL])
       AS href
FROM links""",
    "f2_external_scope": f"WITH {_SEEDS} SELECT page_id, host FROM hosts WHERE {_EXTERNAL}",
    "f3_in_scope": f"""
WITH {_SEEDS}
SELECT page_id, url FROM hosts WHERE {_SEEDED} OR {_EXTERNAL}
UNION ALL
SELECT page_id, regexp_replace(url, '^https?://', 'file:///') FROM pages""",
    "f4_omissions": f"""
WITH {_CALLS}
SELECT call_id AS visit_id, uri FROM keyed
WHERE status IS NULL OR NOT (status BETWEEN 200 AND 299 OR status = 302)""",
    "f5_click_depth": f"""
WITH {_LINKS}
SELECT url, depth_limit, rtrim(repeat(path || ' ', CAST(clicks AS INTEGER))) AS steps
FROM links, unnest(range(4)) AS numbers(clicks), unnest([0, 1]) AS limits(depth_limit)
WHERE depth_limit = 0 OR clicks <= depth_limit""",
    "f6_navigated": f"""
WITH {_LINKS}
SELECT page_id AS visit_id, k AS click_no, href_abs AS current_url FROM links
WHERE origin || href <> split_part(url, '#', 1)""",
    "f7_recordable": f"WITH {_CALLS} SELECT call_id, status FROM keyed WHERE status IS NOT NULL",
    "j1_seed_scope": f"WITH {_SEEDS} SELECT page_id, host FROM hosts WHERE {_SEEDED}",
    "j1_seed_scope_subdomains": _J1,
    "j1_seed_scope_exact": f"""
WITH {_VARIANTS}
SELECT page_id, host FROM variants WHERE host IN (SELECT seed FROM seed_hosts)""",
    "j1_seed_scope_long_list": _J1,
    "j2_response_lookup": f"""
WITH {_CALLS}
SELECT k.call_id, k.request_key, f.call_id IS NOT NULL AS is_hit, f.status AS stored_status,
       md5(f.resp_body) AS stored_md5
FROM keyed k LEFT JOIN (SELECT * FROM firsts WHERE method = 'GET' AND status = 200) f
  ON k.request_key = f.request_key""",
    "j2_uncached": f"""
WITH {_CALLS}
SELECT call_id FROM keyed WHERE request_key NOT IN (
  SELECT request_key FROM firsts WHERE method = 'GET' AND status = 200)""",
    "j3_drop_omitted": f"""
WITH {_CALLS}
SELECT call_id AS visit_id, uri AS url FROM keyed
WHERE status BETWEEN 200 AND 299 OR status = 302""",
    "j4_fresh_navigations": f"""
WITH {_LINKS}
SELECT page_id AS visit_id, k AS click_no, href_abs AS current_url FROM links WHERE k % 2 = 0""",
    "j5_mutation_match": f"""
WITH {_LINKS} SELECT url, path FROM links WHERE k % 2 = 1 AND page_id % 4 <> 0""",
    "j6_pair_records": f"""
WITH {_CALLS}
SELECT method, status, count(*) AS pairs, CAST(sum(octet_length(resp_body)) AS BIGINT) AS bytes
FROM keyed WHERE status IS NOT NULL GROUP BY method, status""",
    "d1_dedup_calls": f"""
WITH {_CALLS} SELECT call_id, request_key, status, md5(resp_body) AS body_md5 FROM firsts""",
    "d2_unvisited": f"""
WITH {_CALLS}
SELECT DISTINCT canonical AS url FROM keyed
WHERE canonical NOT IN (SELECT canonical FROM keyed WHERE status <> 200)""",
    "d3_politeness_rounds": f"""
WITH {_CALLS}
SELECT call_id, host, row_number() OVER (PARTITION BY host ORDER BY ms, call_id) AS round
FROM keyed""",
    "d4_first_stable": _D4,
    "d4_first_stable_timeout": _STABLE + """
SELECT key, CASE WHEN in_time THEN 'stable' ELSE 'timed_out' END AS outcome,
       CASE WHEN in_time THEN seq END AS stable_seq
FROM (SELECT *, coalesce(stable_ts <= first_ts + INTERVAL 2 DAY, FALSE) AS in_time FROM per_key)""",
    "u1_candidates": f"""
WITH {_LINKS}
SELECT url, path, href_abs, 'attribute' AS source FROM links
UNION ALL
SELECT url, path, href_abs, 'listener' FROM links, unnest(range(2)) AS twice(observation)""",
    "i1_expand_clicks": f"""
WITH {_LINKS}
SELECT url, path AS steps FROM links
UNION ALL
SELECT url, '0>1>0>0>0>0> ' || path FROM links WHERE k % 2 = 1 AND page_id % 4 <> 0""",
    "i2_reclick": f"""
WITH {_LINKS}
SELECT url, '0>1>0>0>0>0> 0>1>0>0>0>0>' AS steps FROM links
WHERE k = 0 AND (page_id % 3 = 0 OR (page_id % 4 <> 0 AND n > 1))""",
    "i3_next_frontier": f"""
WITH {_LINKS}, {_SEEDS}
SELECT DISTINCT origin || href AS url, host, 0 AS clicks
FROM (SELECT *, regexp_extract(origin, '//(.*)$', 1) AS host FROM links)
WHERE {_SEEDED} AND origin || href NOT IN (SELECT split_part(url, '#', 1) FROM pages)""",
    "i3_navigation_refs": f"""
WITH {_LINKS}, {_SEEDS}
SELECT DISTINCT href_abs || '#at' AS url, host, 0 AS clicks
FROM (SELECT *, regexp_extract(origin, '//(.*)$', 1) AS host FROM links)
WHERE {_SEEDED} AND k % 2 = 0 AND origin || href <> split_part(url, '#', 1)
  AND origin || href NOT IN (SELECT origin || href FROM links WHERE page_id % 5 = 0)""",
    "i4_reachable": """
WITH RECURSIVE hosts AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
edges AS (
  SELECT page_id AS src,
         coalesce(lead(page_id) OVER (PARTITION BY host ORDER BY page_id),
                  first_value(page_id) OVER (PARTITION BY host ORDER BY page_id)) AS dst
  FROM hosts),
reached(node) AS (
  SELECT page_id FROM pages WHERE regexp_matches(url, '^http://[^/]+/es/')
  UNION
  SELECT dst FROM reached JOIN edges ON src = node)
SELECT node FROM reached""",
    "t1_stream_record": f"""
WITH {_CALLS} SELECT request_key, call_id, status, md5(resp_body) AS body_md5 FROM firsts""",
    "t2_stream_stable": _D4,
    "t2_stream_shuffled": _STABLE + """,
numbered AS (
  SELECT user_id AS key, event_id AS seq,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM events)
SELECT key, CASE WHEN in_time THEN 'stable' ELSE 'timed_out' END AS outcome,
       CASE WHEN in_time THEN number END AS stable_seq
FROM (SELECT *, coalesce(stable_ts <= first_ts + INTERVAL 2 DAY, FALSE) AS in_time FROM per_key)
LEFT JOIN numbered USING (key, seq)""",
}

# The same rows by another plan.
ORACLES["j2_plain_lookup"] = ORACLES["j2_response_lookup"]
ORACLES["d1_dedup_derived"] = ORACLES["d1_dedup_calls"]
ORACLES["t1_stream_record_any_source"] = ORACLES["t1_stream_record"]
ORACLES["s4_warc_commits"] = ORACLES["s4_warc_sink"]
ORACLES["j6_exchanges"] = ORACLES["s4_warc_sink"]
ORACLES["s3_warc_compressed"] = ORACLES["s3_warc_source"]
