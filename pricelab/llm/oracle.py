"""DuckDB SQL for the queries that SQL can express: pairs, groups by transitive links, counts."""

from __future__ import annotations

_GROUPS = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a
),
grouped AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
"""

VECTOR_LINKS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
),
good AS (
  SELECT DISTINCT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0
),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.95
),
{_GROUPS},
counted AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(g.component, v.vec_id) AS component_id,
       coalesce(g.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN grouped g ON g.id = v.vec_id LEFT JOIN counted c ON c.id = v.vec_id
"""

SHINGLE_GROUPS = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2
),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
),
{_GROUPS}
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(g.component, d.doc_id) AS component_id
FROM words d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN grouped g ON g.id = d.doc_id
"""

HARD_NEGATIVES = """
WITH given AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings
),
v AS (
  SELECT DISTINCT id, label, list_transform(x, lambda y: floor(256 * y)) AS q FROM given
  WHERE id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, c.id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.id % 100 = 0 AND a.id <> c.id AND len(a.q) = len(c.q)
),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 5
"""

EXACT_GROUPS = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

COLLOCATIONS = """
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
),
counts AS (
  SELECT lang, p, CAST(count(*) AS HUGEINT) AS n FROM (
    SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM words WHERE len(w) > 0)
  GROUP BY ALL
),
totals AS (SELECT lang, sum(n) AS n FROM counts WHERE len(p) = 1 GROUP BY lang),
cuts AS (SELECT lang, p, n AS a, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1 AND n >= 100),
best AS (
  SELECT c.lang, c.p, c.a, c.k, l.n AS l, r.n AS r, t.n AS n, 1000 * c.a * t.n // (l.n * r.n) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY 1000 * c.a * t.n // (l.n * r.n), c.k) = 1
),
inner_parts AS (
  SELECT lang, p[i:j] AS p, a FROM (
    SELECT lang, p, a, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM best WHERE len(p) > 2))
  WHERE j - i + 1 < len(p)
),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.p = b.p AND 100 * i.a >= 100 * b.a)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank FROM kept)
WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_vector_dedup": VECTOR_LINKS,
    "op4_ngram_join": SHINGLE_GROUPS,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_exact_dedup": EXACT_GROUPS,
    "op13_collocations": COLLOCATIONS,
}
