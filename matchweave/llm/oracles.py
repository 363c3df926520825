"""SQL of the registered queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from matchweave.llm.quality import BOILERPLATE

URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url FROM pages
), parsed AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, coalesce(rest, '') AS rest FROM cut)
), tracking AS (SELECT DISTINCT host FROM parsed WHERE contains(url, 'utm_source=') AND host <> ''),
ruled AS (
  SELECT page_id, host, path, host IN (SELECT host FROM tracking) AS listed_host,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed_host THEN 'block' ELSE 'allow' END AS verdict, listed_host
FROM ruled
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TRIM = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) > 4),
seq AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM win),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM seq) WHERE c > 1),
cover AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(5, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 5)) AS n FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, line, {_TRIM} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
marked AS (SELECT doc_id, line, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(t, '[|»›·•]| > ')) AS cells, len(regexp_extract_all(t, '[#*$%&|<>{{}}\\^~=]')) AS marks, len(regexp_extract_all(t, '[!?]{{2,}}')) AS cries FROM lines),
judged AS (SELECT doc_id, line, length(line) AS chars, NOT (regexp_matches(lower(t), '{"|".join(BOILERPLATE)}') OR (cells >= 2 AND n <= 5 * (cells + 1)) OR marks > 0.1 * length(t) OR cries > greatest(1, 0.34 * n)
  OR (n < 4 AND NOT regexp_matches(t, '[.!?…。！？।؟:;]["''”“’‘»«)\]]*$'))) AS good FROM marked),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (NOT good) AS n_lines_failed, sum(chars) AS chars, coalesce(sum(chars) FILTER (good), 0) AS good_chars FROM judged GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_lines_failed, 0)::INT AS n_lines_failed, coalesce(chars, 0) AS chars, coalesce(good_chars, 0) AS good_chars
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars - good_chars <= 0.5 * chars AS kept, n_lines, n_lines_failed FROM base
"""

_COMPONENTS = """reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings),
u AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
nodes AS (SELECT id FROM v), {_COMPONENTS}
SELECT v.id AS vec_id, (SELECT count(*) FROM links WHERE a = v.id) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN comp USING (id)
"""

SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p:p + 34], ' ')) AS c FROM win) WHERE c > 1),
edge AS (SELECT doc_id, p, 1 AS step FROM rep UNION ALL SELECT doc_id, p + 35, -1 FROM rep),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
depth AS (SELECT w.doc_id, w.p, w.x, sum(coalesce(e.step, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS depth FROM word w LEFT JOIN (SELECT doc_id, p, sum(step) AS step FROM edge GROUP BY ALL) e USING (doc_id, p))
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (depth > 0) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (depth = 0) AS kept FROM depth GROUP BY doc_id) c USING (doc_id)
"""

MINHASH_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] ELSE w END) AS g FROM d),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
ranked AS (SELECT s.id, n.n, s.g, row_number() OVER (PARTITION BY s.id ORDER BY f.f, s.g) AS r FROM s JOIN n USING (id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g)),
-- of two similar sets, the rarest fifth of each (and one more) share a shingle
rare AS (SELECT id, n, g FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM rare a JOIN rare b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
pairs AS (SELECT c.a, c.b FROM cand c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b AND y.g = x.g GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), nodes AS (SELECT id FROM d), {_COMPONENTS}
SELECT d.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.id = component_id AS kept FROM d JOIN comp USING (id) LEFT JOIN n USING (id)
"""


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
CHAT_SQL = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_ESCAPED.format("text")} AS esc FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
  len(regexp_extract_all(esc, '[A-Za-z]{{1,2}}|[0-9]{{1,2}}|[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')) + len(regexp_extract_all(esc, ' ')) - len(regexp_extract_all(esc, ' +'))
    + strlen(regexp_replace(esc, '[\x00-\x7F]+', '', 'g')) + 5 AS n,
  8 + length(replace({_ESCAPED.format("role")}, chr(10), '&#10;')) + 1 + length(esc) + 8 AS size FROM e),
s AS (SELECT *, place = 1 AND role = 'system' AS sys FROM c),
h AS (SELECT *, 512 - coalesce(first_value(CASE WHEN sys THEN n END) OVER o, 0) AS rest,
  greatest(0, CASE WHEN NOT lag(sys, 1) OVER o AND lag(n, 1) OVER o <= 96 THEN lag(n, 1) OVER o END, CASE WHEN NOT lag(sys, 2) OVER o AND lag(n, 1) OVER o + lag(n, 2) OVER o <= 96 THEN lag(n, 1) OVER o + lag(n, 2) OVER o END) AS history
  FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
body AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS r, history > 0 AND history + n <= rest AS room FROM h WHERE NOT sys),
fold(conv_id, r, win, used, repeats) AS (
  SELECT conv_id, r, 0, n, false FROM body WHERE r = 1
  UNION ALL SELECT b.conv_id, b.r, CASE WHEN f.used + b.n <= b.rest THEN f.win ELSE f.win + 1 END, CASE WHEN f.used + b.n <= b.rest THEN f.used + b.n WHEN b.room THEN b.history + b.n ELSE b.n END,
    f.used + b.n > b.rest AND b.room FROM fold f JOIN body b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.r = f.r + 1),
l AS (SELECT b.place, f.conv_id, f.win, b.n, lead(f.win, 1) OVER o AS w1, lead(f.win, 2) OVER o AS w2, lead(f.repeats, 1) OVER o AS r1, lead(f.repeats, 2) OVER o AS r2, lead(b.n, 1) OVER o AS n1
  FROM fold f JOIN body b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.r = f.r WINDOW o AS (PARTITION BY f.conv_id ORDER BY b.place)),
k AS (SELECT conv_id, place, 1 + coalesce(w1 <> win AND r1 AND n <= 96, false)::INT + coalesce(w2 <> w1 AND r2 AND n + n1 <= 96, false)::INT AS copies FROM l),
m AS (SELECT conv_id, 1 + max(win) AS n_windows FROM fold GROUP BY conv_id),
x AS (SELECT s.*, coalesce(m.n_windows, 1) AS n_windows, CASE WHEN s.sys THEN coalesce(m.n_windows, 1) ELSE k.copies END AS copies
  FROM s LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.place = s.place LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(copies * size)::BIGINT AS formatted_chars,
  max(n_windows)::BIGINT AS n_windows, sum(copies * n)::BIGINT AS n_tokens FROM x GROUP BY conv_id
"""


#: CRC-32 of a text of digits, bit by bit.
CRC_MACRO = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"

ENCODING_SQL = f"""
WITH f AS (SELECT sale_id, sold_at AS moment, coalesce(client_id, -1) AS client_id, {CRC_MACRO.format("sale_id::VARCHAR")} % 5 AS fold FROM sales WHERE sold_at IS NOT NULL),
b AS (SELECT f.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, f.client_id, f.moment, f.fold, i.kind, v.nation_id, c.segment, count(*) AS n, count(*) FILTER (l.flag = 'returned') AS s
  FROM sale_lines l JOIN f USING (sale_id) LEFT JOIN items i ON i.item_id = coalesce(l.item_id, -1) LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = f.client_id GROUP BY ALL),
x AS (SELECT moment, fold, n, s, unnest(['all', 'kind', 'nation', 'segment', 'item', 'vendor', 'client']) AS col,
  unnest(['', coalesce(kind, '?'), coalesce(nation_id::VARCHAR, '?'), coalesce(segment, '?'), item_id::VARCHAR, coalesce(vendor_id::VARCHAR, '?'), client_id::VARCHAR]) AS key FROM b),
k AS (SELECT col, key, moment, sum(sum(n)) OVER w AS n, sum(sum(s)) OVER w AS s FROM x GROUP BY col, key, moment WINDOW w AS (PARTITION BY col, key ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT col, key, fold, moment, sum(sum(n)) OVER w AS n, sum(sum(s)) OVER w AS s FROM x GROUP BY col, key, fold, moment WINDOW w AS (PARTITION BY col, key, fold ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT o.col, o.key, o.fold, o.moment, (coalesce(k.n, 0) - coalesce(o.n, 0))::BIGINT AS n, (coalesce(k.s, 0) - coalesce(o.s, 0))::BIGINT AS s FROM o JOIN k USING (col, key, moment)),
g AS (SELECT moment, fold, CASE WHEN n < 1 THEN 500000 ELSE (1000000 * s + 50 * 500000) // (n + 50) END AS p FROM h WHERE col = 'all'),
r AS (SELECT col, key, moment, fold, CASE WHEN n < 1 THEN p ELSE (1000000 * s + 50 * p) // (n + 50) END AS p FROM h JOIN g USING (moment, fold) WHERE col IN ('kind', 'nation', 'segment'))
SELECT b.sale_id, b.item_id, b.vendor_id, b.n AS n_lines, b.s AS n_returned,
  hi.n AS item_n, (CASE WHEN hi.n < 1 THEN ri.p ELSE (1000000 * hi.s + 50 * ri.p) // (hi.n + 50) END)::BIGINT AS item_rate,
  hv.n AS vendor_n, (CASE WHEN hv.n < 1 THEN rv.p ELSE (1000000 * hv.s + 50 * rv.p) // (hv.n + 50) END)::BIGINT AS vendor_rate,
  hc.n AS client_n, (CASE WHEN hc.n < 1 THEN rc.p ELSE (1000000 * hc.s + 50 * rc.p) // (hc.n + 50) END)::BIGINT AS client_rate
FROM b JOIN h hi ON hi.col = 'item' AND hi.key = b.item_id::VARCHAR AND hi.moment = b.moment AND hi.fold = b.fold JOIN r ri ON ri.col = 'kind' AND ri.key = coalesce(b.kind, '?') AND ri.moment = b.moment AND ri.fold = b.fold
JOIN h hv ON hv.col = 'vendor' AND hv.key = coalesce(b.vendor_id::VARCHAR, '?') AND hv.moment = b.moment AND hv.fold = b.fold JOIN r rv ON rv.col = 'nation' AND rv.key = coalesce(b.nation_id::VARCHAR, '?') AND rv.moment = b.moment AND rv.fold = b.fold
JOIN h hc ON hc.col = 'client' AND hc.key = b.client_id::VARCHAR AND hc.moment = b.moment AND hc.fold = b.fold JOIN r rc ON rc.col = 'segment' AND rc.key = coalesce(b.segment, '?') AND rc.moment = b.moment AND rc.fold = b.fold
"""


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC_MACRO.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.i, t.turn_hash, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.turn_hash, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
n AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(turn_hash, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
m AS (SELECT conv_id, depth, path, chars FROM n UNION ALL SELECT conv_id, 0, '', 0 FROM c),
z AS (SELECT conv_id, max(depth) AS size FROM m GROUP BY conv_id),
v AS (SELECT m.path, min(m.depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(m.chars) AS chars,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (m.depth = z.size), '')) AS ends_sha256 FROM m JOIN z USING (conv_id) GROUP BY m.path),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * chars AS own_saved FROM v LEFT JOIN k USING (path)),
s AS (SELECT DISTINCT a.path, b.path AS below FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
u AS (SELECT s.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.own_saved)::BIGINT AS saved_tokens FROM s JOIN w b ON b.path = s.below GROUP BY s.path)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, w.ends_sha256
FROM w JOIN u USING (path) LEFT JOIN v p ON w.depth > 0 AND p.path = left(w.path, length(w.path) - 64)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL, "op2_line_quality": QUALITY_SQL, "op3_embedding_dedup": EMBEDDING_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op5_minhash_dedup": MINHASH_SQL, "op6_chat_windows": CHAT_SQL, "op11_prefix_trie": TRIE_SQL, "op12_target_encoding": ENCODING_SQL}
