"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from codeloom.llm import problems

QUERIES = {**problems.QUERIES}
SQL = {
    "p7_token_counts": r"""
SELECT doc_id, coalesce(len(regexp_extract_all(text,
  '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\t\n\v\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')), 0)::BIGINT AS tokens
FROM documents
""",
    "p5_recall_floor": """
SELECT model_id, count(*) AS n_queries, true AS reached FROM reuse_vectors
WHERE vec_id % 100 = 0 AND len(vector) = 64 AND model_id IS NOT NULL AND len([x FOR x IN vector IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0
GROUP BY model_id
""",
    "p5_found": """
WITH v AS (
  SELECT vec_id, model_id, vector::DOUBLE[] AS vector FROM reuse_vectors WHERE len(vector) = 64 AND vec_id IS NOT NULL AND model_id IS NOT NULL
    AND len([x FOR x IN vector IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.vector, b.vector), 12) AS cosine FROM v a JOIN v b ON a.model_id = b.model_id AND a.vec_id <> b.vec_id
), best AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5
)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM best WHERE cosine >= 0.9
""",
}
