"""The same results as SQL, where SQL can express them."""

from __future__ import annotations

from tagloom.llm.queries import NOTICES

ORACLES: dict[str, str] = {}

ORACLES["op7_exact_dedup"] = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""

ORACLES["op9_decontaminate"] = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM wins),
found AS (
  SELECT d.doc_id, i, s.size, win.item_id
  FROM docs d, sizes s, unnest(range(1, greatest(0, len(d.w) - s.size + 1) + 1)) AS t(i)
  JOIN wins win ON win.size = s.size AND win.win = array_to_string(d.w[i : i + s.size - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1
), names AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT cast(item_id AS VARCHAR))) AS ids FROM found GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""

ORACLES["op8_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM words, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""

ORACLES["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, l AS line,
         translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), often AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, i, line, k IN (SELECT k FROM often) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_NOTICES = ", ".join(f"('{name}', '{text}')" for name, text in NOTICES)
ORACLES["op1_license_scan"] = r"""
WITH files AS (
  SELECT doc_id, text, doc_id % 10 = 0 AS whole, concat_ws('/', source,
    CASE WHEN doc_id % 10 = 0 AND doc_id % 200 < 100 THEN NULL ELSE cast(doc_id % 7 AS VARCHAR) END,
    CASE WHEN doc_id % 10 <> 0 THEN cast(doc_id % 3 AS VARCHAR) END,
    CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM documents
), templates AS (SELECT row_number() OVER () AS tid, name, body FROM (VALUES @NOTICES@) AS t(name, body)
), twords AS (
  SELECT tid, name, w, count(*) AS n FROM (
    SELECT tid, name, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM templates
  ) GROUP BY ALL
), passages AS (
  SELECT doc_id, i, unnest(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM files
    UNION ALL SELECT doc_id, coalesce(text, ''), 0 FROM files WHERE whole)
), pwords AS (SELECT doc_id, i, w, count(*) AS n FROM passages GROUP BY ALL
), total AS (SELECT count(*) AS files FROM files
), idf AS (
  SELECT w, ln((max(files) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT w FROM twords) LEFT JOIN pwords USING (w), total GROUP BY w
), norms AS (
  SELECT doc_id, i, sqrt(sum((n * coalesce(idf, ln(files + 1) + 1)) ** 2)) AS norm
  FROM pwords LEFT JOIN idf USING (w), total GROUP BY doc_id, i
), tnorms AS (SELECT tid, sqrt(sum((n * idf) ** 2)) AS norm FROM twords JOIN idf USING (w) GROUP BY tid
), likeness AS (
  SELECT p.doc_id, t.name, round(sum(p.n * t.n * idf.idf * idf.idf) / (max(norms.norm) * max(tnorms.norm)), 6) AS likeness
  FROM pwords p JOIN twords t USING (w) JOIN idf USING (w)
  JOIN norms ON norms.doc_id = p.doc_id AND norms.i = p.i JOIN tnorms USING (tid)
  GROUP BY p.doc_id, p.i, t.tid, t.name
), own AS (
  SELECT doc_id, name, likeness FROM likeness WHERE likeness >= 0.6
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY likeness DESC, name) = 1
), marked AS (
  SELECT doc_id, path, whole, name, likeness, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files LEFT JOIN own USING (doc_id)
), given AS (
  SELECT directory, name, path FROM marked WHERE whole AND name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY likeness DESC, name, path) = 1
), nearest AS (
  SELECT d.directory, g.name, g.path
  FROM (SELECT DISTINCT directory FROM marked) d JOIN given g ON d.directory = g.directory OR starts_with(d.directory, g.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(g.directory) DESC) = 1
)
SELECT m.doc_id, m.path, m.name AS own_license, m.likeness AS similarity, coalesce(m.name, n.name) AS license,
       CASE WHEN m.name IS NULL THEN n.path END AS inherited_from
FROM marked m LEFT JOIN nearest n USING (directory)
""".replace("@NOTICES@", _NOTICES)
