"""Query op4: near-duplicate embeddings."""

from __future__ import annotations

from .common import read
from .embed import near_duplicates
from .registry import register

THRESHOLD = 0.93

SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label,
         embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE ok),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""


@register("op4_embedding_dedup", SQL)
def op4_embedding_dedup(spark, sf_dir):
    """Links and components of all embeddings of equal labels."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), THRESHOLD)
