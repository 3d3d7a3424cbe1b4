"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

# crc32 of an ASCII text: the bits of each byte through the reversed polynomial, a fixed value.
CRC32 = """(4294967295 - list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
        lambda c, bit: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))))"""

_REPAIR = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), fated AS (SELECT *, CRC32 % 20 AS fate FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         regexp_replace(text, '[ 	-]+$', '') AS bare
  FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
         CASE WHEN bare = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), ins(s, reached, cost, audit, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
  (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])
), edits(state, too, edit, initial, cost, role) AS (VALUES
  (0, 0, 'D', '', 3, ''), (1, 1, 'D', '', 3, ''), (2, 2, 'D', '', 3, ''), (3, 3, 'D', '', 3, ''),
  (0, 2, 'R', '', 2, 'user'), (1, 2, 'R', '', 2, 'user'), (2, 3, 'R', '', 2, 'assistant'), (3, 2, 'R', '', 2, 'user'),
  (0, 1, 'K', 's', 0, ''), (0, 2, 'K', 'u', 0, ''), (1, 2, 'K', 'u', 0, ''), (3, 2, 'K', 'u', 0, ''), (2, 3, 'K', 'a', 0, '')
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS x FROM conversations
  UNION ALL
  SELECT b.conv_id, r.i, e.too,
         min({'cost': b.x.cost + n.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END,
              'audit': b.x.audit || n.audit || e.edit,
              'lines': b.x.lines || n.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'R' THEN [e.role || ':' || r.text]
                                                 ELSE [r.role || ':' || r.text] END})
  FROM best b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
  JOIN ins n ON n.s = b.s JOIN edits e ON e.state = n.reached AND (e.edit <> 'K' OR e.initial = r.initial)
       AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv_id, r.i, e.too
), ended AS (
  SELECT b.conv_id, b.i,
         min({'cost': b.x.cost + n.cost, 'audit': b.x.audit || n.audit, 'lines': b.x.lines || n.lines}) AS x
  FROM best b JOIN ins n ON n.s = b.s AND n.reached IN (0, 3) GROUP BY b.conv_id, b.i
), figures AS (
  SELECT c.conv_id, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, coalesce(max(j.i), 0) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id
), pairs AS (
  SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged) GROUP BY conv_id
)
SELECT f.conv_id, gaps, blank, duplicate, truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.x.cost::BIGINT AS cost, e.x.audit AS audit,
       sha256(array_to_string(e.x.lines, chr(10))) AS repaired_sha256
FROM figures f LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM f.conv_id
JOIN ended e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.n
""".replace("CRC32", CRC32.format("name"))

_TRIE = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
         ORDER BY turn NULLS FIRST, coalesce(role, ''),
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), fated AS (SELECT conv_id, conv_id::VARCHAR AS name, turns FROM own
), planned AS (SELECT conv_id, turns, (CRC32 % 6)::BIGINT AS h, conv_id - conv_id % 100 AS donor FROM fated
), rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(o.turns, [])[1:p.h], p.turns[p.h + 1:]) AS turns
  FROM planned p LEFT JOIN own o ON o.conv_id = p.donor
), starts AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), members AS (SELECT conv_id, n, depth, turns[1:depth] AS prefix FROM starts
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[depth].text) END AS saved
  FROM members GROUP BY prefix, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), below AS (
  SELECT a.prefix, a.depth, count(*) FILTER (d.n_children = 0) AS n_leaves, sum(d.saved) AS saved_tokens
  FROM linked a JOIN linked d ON d.depth >= a.depth AND d.prefix[1:a.depth] = a.prefix GROUP BY a.prefix, a.depth
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, l.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(l.ends) AS ends_sha256
FROM linked l JOIN below b ON b.depth = l.depth AND b.prefix = l.prefix
""".replace("CRC32", CRC32.format("name"))

_REPEATS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT r, d, p, substr(x, (2 * p + 1)::INT, 100) AS w
  FROM (SELECT r, d, x, unnest(range(0, length(x) // 2 - 49)) AS p FROM texts WHERE length(x) >= 100)
), first AS (SELECT w, min(d) AS d FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (SELECT v.r, v.p, lag(v.p) OVER (PARTITION BY v.r ORDER BY v.p) AS q FROM windows v JOIN first f ON f.w = v.w AND f.d < v.d
), numbered AS (
  SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS s FROM hits
), spans AS (SELECT r, s, min(p) AS b, max(p) + 50 AS e FROM numbered GROUP BY r, s
), pieces AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS after FROM spans
), cut AS (
  SELECT t.r, count(*) AS n_spans, sum(e - b) AS n_removed,
         string_agg(substr(t.x, (2 * after + 1)::INT, (2 * (b - after))::INT), '' ORDER BY b) || substr(any_value(t.x), (2 * max(e) + 1)::INT) AS kept
  FROM pieces p JOIN texts t ON t.r = p.r GROUP BY t.r
)
SELECT t.doc_id, (length(t.x) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(c.kept, t.x))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.r = t.r
"""

ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _REPAIR,
    "op12_prefix_trie": _TRIE,
    "op13_suffix_dedup": _REPEATS,
    "op10_exact_dedup": r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), ranked AS (
  SELECT doc_id,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size,
         sha256(content) AS text_sha256
  FROM norm
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked
""",
}
