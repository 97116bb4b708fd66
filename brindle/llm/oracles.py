"""SQL, for DuckDB, of the queries that are too long to stand beside them."""

from __future__ import annotations

from brindle.llm import licenses

#: CRC-32 of a string in SQL: the table of its 256 remainders, and a step for each byte.
_CRC = "list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, o: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END))"


def _crc_of(s: str, crc: str = "crc") -> str:
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, b: xor(c // 256, {crc}[(xor(c, b) % 256) + 1])))"


OP11_SQL = rf"""
WITH RECURSIVE x AS MATERIALIZED (SELECT {_CRC} AS crc),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT i, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY i, w),
h AS (SELECT w, n, {_crc_of("i || ':' || w")} AS h FROM c, x),
g AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, (h % length(w)) + 2) ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
k AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
d AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS less, left(w, i - 1) || chr(1) || substr(w, i + 1) AS other FROM k),
p AS (SELECT a.w AS w, b.w AS o, b.n AS m FROM d a JOIN d b ON a.other = b.other AND a.w <> b.w
  UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.less = v.w UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.less = v.w),
s AS (SELECT w, count(*) AS n_near, min({{'less': -m, 'o': o}}) AS best FROM p GROUP BY w),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.o END AS form, CASE WHEN -best.less >= 10 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN s USING (w)),
t(w, root, depth) AS (SELECT w, w, 0 FROM f UNION ALL SELECT t.w, f.form, depth + 1 FROM t JOIN f ON t.root = f.w AND f.form IS NOT NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM f JOIN (SELECT w, arg_max(root, depth) AS root FROM t GROUP BY w) USING (w)
"""

#: Edits of a turn and what they give, by states of the grammar (0 start, 1 after s, 2 after u, 3 after a).
OP12_SQL = rf"""
WITH RECURSIVE x AS MATERIALIZED (SELECT {_CRC} AS crc),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, x),
e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS i FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM e),
r AS (SELECT *, left(role, 1) AS y, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS duo FROM o),
grammar(a, y, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(a, b, cost, audit, said) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
  (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
arcs AS MATERIALIZED (
  SELECT r.conv_id, r.k, p.a, p.b, p.cost + 4 AS cost, p.audit || 'D' AS audit, p.said FROM r, put p
  UNION ALL SELECT r.conv_id, r.k, p.a, g.b, p.cost + 3 * CAST(fault = 'truncated' AS INT), p.audit || 'K', p.said || chr(10) || role || ':' || text FROM r, put p, grammar g WHERE fault NOT IN ('blank', 'duplicate') AND g.a = p.b AND g.y = r.y
  UNION ALL SELECT r.conv_id, r.k, p.a, g.b, p.cost + 3 + 3 * CAST(fault = 'truncated' AS INT), p.audit || 'R', p.said || chr(10) || CASE g.y WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text FROM r, put p, grammar g WHERE fault NOT IN ('blank', 'duplicate') AND g.a = p.b AND g.y <> 's'),
w(conv_id, k, s, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': 0, 'audit': '', 'said': ''}} FROM r
  UNION ALL
  SELECT arcs.conv_id, arcs.k, arcs.b, min({{'cost': w.best.cost + arcs.cost, 'audit': w.best.audit || arcs.audit, 'said': w.best.said || arcs.said}})
  FROM w JOIN arcs ON w.conv_id IS NOT DISTINCT FROM arcs.conv_id AND arcs.k = w.k + 1 AND arcs.a = w.s GROUP BY arcs.conv_id, arcs.k, arcs.b),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (k > 1 AND duo NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
z AS (SELECT w.conv_id, min({{'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.audit, 'said': w.best.said || p.said}}) AS best
  FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.k = n.n JOIN put p ON p.a = w.s AND p.b IN (0, 3) GROUP BY w.conv_id)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(z.best.cost, 0) AS BIGINT) AS cost, coalesce(z.best.audit, '') AS audit, sha256(substr(coalesce(z.best.said, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON q.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON q.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def _texts(rows) -> str:
    return ", ".join(f"({', '.join(str(v) if isinstance(v, int) else chr(39) + v + chr(39) for v in r)})" for r in rows)


#: Phrases are looked for in words joined by blanks, which stand twice so that neighbours don't share one.
#: Blocks are held against all templates of their size class.
OP13_SQL = rf"""
WITH phrases(label, phrase) AS (VALUES {_texts(licenses.PHRASES)}),
templates AS MATERIALIZED (SELECT label, size, list_distinct(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: w <> '')) AS mine FROM (VALUES {_texts((label, licenses.size_class(len(licenses.split_words(text))), text) for label, text in licenses.TEMPLATES)}) t(label, size, body)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, label, unnest(range(len(w))) AS i, w, string_split(phrase, ' ') AS x FROM d, phrases WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')),
q AS (SELECT rid, label, i FROM p WHERE w[i + 1:i + len(x)] = x),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS labels FROM q GROUP BY rid),
s AS (SELECT rid, size, unnest(range(0, len(w), size)) AS i, w FROM d, (SELECT DISTINCT size FROM templates)),
h AS (SELECT rid, label, len(list_intersect(mine, w[i + 1:i + 2 * s.size])) / len(mine) AS c FROM s JOIN templates t ON t.size = s.size),
k AS (SELECT rid, max(c) AS c, list(DISTINCT label) AS labels FROM h WHERE c >= {licenses.THRESHOLD} GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b.labels, k.labels))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(k.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""
