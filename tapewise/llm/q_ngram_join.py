"""Query op8_ngram_join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ngram_join import similar_documents


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_join": op8_ngram_join}

#: Candidate pairs share one of the 1 + floor(n / 5) shingles that are rarest, ties by the shingle: a
#: pair with similarity 0.8 cannot do without.  The recursion carries the smallest id along links.
ORACLES = {
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE range(1, len(ws) - 3) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS df FROM s GROUP BY g),
pre AS (
  SELECT doc_id, g FROM (
    SELECT doc_id, g, n, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM s JOIN df USING (g) JOIN n USING (doc_id))
  WHERE r <= 1 + n // 5 AND df > 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id),
link AS (
  SELECT a, b FROM (
    SELECT a, b, count(*) AS x FROM cand JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b AND q.g = p.g GROUP BY a, b)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IN (SELECT a FROM e)
  UNION
  SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = w.doc_id
"""
}
