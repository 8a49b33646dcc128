"""DuckDB twins of the queries that SQL can express whole."""

from __future__ import annotations

#: Every vector against every other, then the closure of the links.
EMBEDDINGS = """
WITH RECURSIVE every AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS MATERIALIZED (
  SELECT vec_id, v FROM every
  WHERE v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0
),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
),
reach AS (
  SELECT DISTINCT a AS id, a AS other FROM link
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other
),
top AS (SELECT id, min(other) AS least FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM every LEFT JOIN top ON top.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

#: Documents that share a shingle are counted pair by pair, then the closure of the links.
JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w
  FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s
  FROM worded
),
flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT a AS id, a AS other FROM both_ways
  UNION
  SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
),
top AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id
FROM sets LEFT JOIN top ON top.id = doc_id
"""

#: Lines by class; two are one edit apart if they agree without one character at one place, or one is the other without a character.
LINES = r"""
WITH every AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(parts) AS l, generate_subscripts(parts, 1) - 1 AS pos FROM every),
normal AS MATERIALIZED (
  SELECT doc_id, pos, doc_id * CAST(2147483648 AS HUGEINT) + pos AS r,
    translate(regexp_replace(lower(trim(l, ' ' || chr(9) || chr(13))), '[1-9]', '0', 'g'), chr(9) || chr(13), '  ') AS s FROM line
),
class AS MATERIALIZED (SELECT s, length(s) AS n, min(r) AS first FROM normal WHERE s <> '' GROUP BY s),
cut AS MATERIALIZED (SELECT s, n, first, i, substr(s, 1, i) || substr(s, i + 2) AS rest FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS i FROM class WHERE n >= 20)),
near AS MATERIALIZED (
  SELECT b.s FROM cut a JOIN cut b ON a.n = b.n AND a.i = b.i AND a.rest = b.rest AND a.first < b.first
  UNION
  SELECT CASE WHEN a.first > b.first THEN a.s ELSE b.s END FROM cut a JOIN class b ON b.s = a.rest WHERE b.n >= 20
),
gone AS (
  SELECT doc_id, list(pos) AS numbers FROM normal JOIN class USING (s) WHERE r <> first OR s IN (SELECT s FROM near) GROUP BY doc_id
),
kept AS (
  SELECT e.doc_id, len(parts) AS n_lines, coalesce(len(numbers), 0) AS n_removed,
    CASE WHEN numbers IS NULL THEN text ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(numbers, i - 1)), chr(10)), '') END AS t
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS kept_chars, md5(t) AS kept_md5 FROM kept
"""

ORACLES = {"op3_embedding_dedup": EMBEDDINGS, "op6_line_dedup": LINES, "op9_jaccard_join": JACCARD}
