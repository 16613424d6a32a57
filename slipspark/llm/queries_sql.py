"""DuckDB SQL that checks the queries which SQL can express, from the words of their contracts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op2_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS k
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes),
hits AS (
  SELECT s.doc_id, s.i, s.n, win.item
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM spots) s JOIN win USING (n, k)
),
places AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, least(len(w), 4) AS width, array_to_string(list_slice(w, i, i + 3), ' ') AS k FROM spots),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (width, k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
    "op8_line_dedup": rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM split),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
),
firsts AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_collocations": rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT doc, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (
  SELECT lang, unnest([list_slice(w, i, i), CASE WHEN i + 1 <= len(w) THEN list_slice(w, i, i + 1) END, CASE WHEN i + 2 <= len(w) THEN list_slice(w, i, i + 2) END]) AS g
  FROM spots
),
f AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM grams WHERE g IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.g, c.k, c.f AS a, x.k AS cut, x.f AS l, y.f AS r,
    CAST(c.f AS HUGEINT) * c.f * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.g = list_slice(c.g, 1, x.k)
  JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.g = list_slice(c.g, x.k + 1, c.k)
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.g FROM c s JOIN c b ON b.lang = s.lang AND s.k = 2 AND b.k = 3
    AND (list_slice(b.g, 1, 2) = s.g OR list_slice(b.g, 2, 3) = s.g) AND 100 * b.f >= 50 * s.f
),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank
  FROM best ANTI JOIN inside USING (lang, g)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
}
