"""DuckDB's SQL for the operators that it can express."""

from __future__ import annotations

import string

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SOURCE_DIVERGENCE = f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
occurrences AS (SELECT id, lang, source, unnest(words) AS term FROM rows_),
kept AS (
  SELECT lang, term, count(*) AS total FROM occurrences GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
groups_ AS (SELECT DISTINCT lang, source FROM rows_),
counts AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL),
lang_size AS (SELECT lang, sum(total) + 2 * count(*) AS size FROM kept GROUP BY lang),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
size AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) + 2 * max(t.v) AS size
  FROM groups_ g JOIN terms t USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // s.size::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.total + 2) // l.size::HUGEINT AS q
  FROM size s JOIN kept k USING (lang) JOIN lang_size l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
all_ AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM all_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# CRC-32 byte by byte and bit by bit; the polynomial is a fixed value.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"""

CONVERSATION_REPAIR = f"""
WITH RECURSIVE
source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
kinds AS (SELECT *, {_CRC.format("place")} % 20 AS kind FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         left(role, 1) AS initial FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id),
-- States: 0 nothing yet, 1 after a system turn, 2 after a user, 3 after an assistant.
inserts(p, q, n, edits, said) AS (
  VALUES (0, 0, 0, '', []), (0, 2, 1, 'I', ['user:']), (0, 3, 2, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []),
         (1, 2, 1, 'I', ['user:']), (1, 3, 2, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 1, 'I', ['assistant:']),
         (2, 2, 2, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []), (3, 2, 1, 'I', ['user:']), (3, 3, 2, 'II', ['user:', 'assistant:'])),
fits(q, t, initial, role) AS (VALUES (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
options AS (
  SELECT f.conv_id, f.i, x.p, o.t, 2 * x.n + o.cost + CASE WHEN f.fault = 'truncated' AND o.op <> 'D' THEN 1 ELSE 0 END AS cost,
         x.edits || o.op AS edits, x.said || CASE o.op WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [o.role || ':' || f.text] END AS said
  FROM faulty f, inserts x, (
    SELECT q, q AS t, 'D' AS op, 3 AS cost, NULL AS initial, NULL AS role FROM fits UNION ALL
    SELECT q, t, 'R', 2, NULL, role FROM fits UNION ALL
    SELECT q, t, 'K', 0, initial, NULL FROM fits UNION ALL SELECT 0, 1, 'K', 0, 's', NULL) o
  WHERE o.q = x.q AND (o.op = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (o.op <> 'K' OR o.initial = f.initial)),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM counts
  UNION ALL
  SELECT w.conv_id, w.i + 1, o.t, min(w.cost + o.cost), arg_min(w.audit || o.edits, (w.cost + o.cost, w.audit || o.edits)),
         arg_min(w.said || o.said, (w.cost + o.cost, w.audit || o.edits))
  FROM ways w JOIN options o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 AND o.p = w.state
  GROUP BY w.conv_id, w.i, o.t),
closed AS (
  SELECT w.conv_id, w.cost + 2 * x.n AS cost, w.audit || x.edits AS audit, w.said || x.said AS said
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  JOIN inserts x ON x.p = w.state AND (x.q = 3 OR (x.p = 0 AND x.q = 0))),
best AS (
  SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit,
         sha256(array_to_string(arg_min(said, (cost, audit)), chr(10))) AS repaired_sha256 FROM closed GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, coalesce(b.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
"""

NEAR_COPIES = f"""
WITH RECURSIVE
texts AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT row_id, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM texts),
classes AS (SELECT min(row_id) AS class, list_sort(grams) AS grams, len(any_value(grams)) AS n FROM sets GROUP BY list_sort(grams)),
members AS (SELECT s.row_id, s.doc_id, len(s.grams) AS n, CASE WHEN len(s.grams) > 0 THEN c.class ELSE -s.row_id END AS class
            FROM sets s JOIN classes c ON c.grams = list_sort(s.grams)),
spread AS (SELECT class, n, unnest(grams) AS gram FROM classes),
common AS (
  SELECT a.class AS a, b.class AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS both_
  FROM spread a JOIN spread b ON a.gram = b.gram AND a.class < b.class GROUP BY a.class, b.class),
links AS (SELECT a, b FROM common WHERE 100 * both_ >= 80 * (n + m - both_)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT class, class FROM members UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
named AS (SELECT r.a AS class, min(m.doc_id) AS component_id FROM reach r JOIN members m ON m.class = r.b GROUP BY r.a)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, c.component_id, m.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM members m JOIN named c USING (class)
"""
