"""DuckDB SQL for the queries of this subpackage."""

REPETITION = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, unnest(range(1, len(ws) - k + 2)) AS i, k,
         unnest(list_transform(range(1, len(ws) - k + 2), lambda i: md5(array_to_string(ws[i:i + k - 1], ' ')))) AS h
  FROM w, (VALUES (5), (8), (61)) AS t(k) WHERE len(ws) >= k),
again AS (
  SELECT r, k, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k, h) > 1),
marked AS (
  SELECT r, k, i, lag(i) OVER (PARTITION BY r, k ORDER BY i) AS before FROM again),
m AS (
  SELECT r, coalesce(sum(CASE WHEN before IS NULL THEN k ELSE least(k, i - before) END) FILTER (k = 5), 0) AS n5,
         coalesce(sum(CASE WHEN before IS NULL THEN k ELSE least(k, i - before) END) FILTER (k = 8), 0) AS n8,
         count(*) FILTER (k = 61) AS n61
  FROM marked GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
q AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n5, 0)::BIGINT AS n_repeat_words,
    coalesce(n8, 0)::BIGINT AS n_covered_words, coalesce(n61, 0) AS n61
  FROM w LEFT JOIN lines USING (r) LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_covered_words <= 18 * n_words AND n61 = 0 AS kept,
  n_covered_words
FROM q
"""

URLS = r"""
WITH RECURSIVE s AS MATERIALIZED (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
l AS MATERIALIZED (
  SELECT url, unnest(list_filter([
      regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(html, '(?i)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
      regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)], lambda x: x <> '')) AS raw
  FROM s WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'refresh')),
link AS (
  SELECT url, CASE WHEN contains(raw, '://') THEN raw WHEN starts_with(raw, '//') THEN 'http:' || raw
    WHEN starts_with(raw, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || raw END AS target
  FROM l WHERE contains(url, '://')),
u AS (SELECT DISTINCT url FROM s UNION SELECT target FROM link WHERE target IS NOT NULL),
p AS MATERIALIZED (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_\w+|ref)(?:=|$)'))) AS query FROM u),
j AS MATERIALIZED (
  SELECT url, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(?:(?:www|m)\.)+', '')
      || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '') || '?' || array_to_string(query, '&') END AS form,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
e AS MATERIALIZED (
  SELECT a.form AS x, b.form AS y FROM link JOIN j a ON a.url = link.url JOIN j b ON b.url = link.target WHERE a.form <> b.form),
pairs AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, x FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
label AS (SELECT x, min(y) AS label FROM reach GROUP BY x),
k AS (SELECT j.*, coalesce(label, form) AS label,
    CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given FROM j LEFT JOIN label ON form = x),
g AS (SELECT label, CASE WHEN bool_or(given = 'allow') THEN 'allow' ELSE 'block' END AS inherited FROM k WHERE given IS NOT NULL AND label IS NOT NULL GROUP BY label)
SELECT page_id, host, path, rule, coalesce(given, inherited, 'allow') AS verdict
FROM s JOIN k USING (url) LEFT JOIN g ON g.label = k.label
"""


def _spans(kind: int, pattern: str, group: int, test: str) -> str:
    """Rows (r, start, kind, stop, value) of one pattern's matches."""
    return f"""
  SELECT r, owner, doc_id, gaps + before AS start, {kind} AS kind, gaps + before + size AS stop, value FROM (
    SELECT r, owner, doc_id, unnest(range(1, len(whole) + 1)) AS i,
      list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT AS gaps,
      coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)::BIGINT AS before,
      length(whole[i]) AS size, vals[i] AS value
    FROM (SELECT r, owner, doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS whole,
            regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d)) WHERE {test}"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
c AS MATERIALIZED ({_spans(0, _ASSIGN, 2, "length(value) >= 12")}
  UNION ALL {_spans(1, "AKIA[A-Z0-9]{{14,}}".replace("{{", "{").replace("}}", "}"), 0, "true")}
  UNION ALL {_spans(2, "[0-9a-f]{16,}", 0, "true")}
  UNION ALL {_spans(3, "[A-Za-z0-9+/_-]{20,}", 0, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8")}),
f AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, coalesce(doc_id::VARCHAR, 'null'))) AS repositories FROM c GROUP BY value),
m AS (SELECT c.*, owners < 3 AND repositories < 20 AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS name FROM c JOIN f USING (value)),
g AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM m WHERE kind < 3 OR live GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (r)
"""

AUDIT = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS MATERIALIZED (
  SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
m AS MATERIALIZED (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM f GROUP BY ALL),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
o AS MATERIALIZED (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM b v JOIN b w ON w.bit <> v.bit JOIN b x ON x.bit NOT IN (v.bit, w.bit) JOIN b y ON y.bit NOT IN (v.bit, w.bit, x.bit) JOIN b z ON z.bit NOT IN (v.bit, w.bit, x.bit, y.bit)),
s AS MATERIALIZED (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) AS t(step)),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""

LINES = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS MATERIALIZED (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS MATERIALIZED (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, first IS NOT NULL AND doc_id <> first AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

RUNS = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384::BIGINT) ELSE h >> 1 END), 4294967295::BIGINT) AS h FROM documents),
p AS MATERIALIZED (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, 1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + h // 10 % 8) AS p FROM d),
t AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
w AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM t),
g AS MATERIALIZED (SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS six, i + 6 <= count(*) OVER (PARTITION BY doc_id) AS whole FROM w),
pairs AS MATERIALIZED (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i AND x.whole AND y.whole),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
found AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM isles GROUP BY doc_id, q, isle),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM found WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
lost AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period, (-1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
