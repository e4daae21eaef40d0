"""Query op1: the curriculum mix of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .mix import mix, training_order
from .registry import register

#: Weight 1 fades out, weight 2 stays, weight 3 comes in; the integrals are 1, 2 and 3.
CURRICULA = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 4.0)))


def curriculum(i: int, source: str | None):
    return CURRICULA[i % 3]


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s),
p AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM o),
f AS (SELECT coalesce(min(k), 1000000) AS k0 FROM p WHERE cap * wrest >= w * remain),
t AS (
  SELECT p.source, p.source_size, p.w,
         CASE WHEN p.k < k0 THEN p.cap::DOUBLE
              ELSE p.w::DOUBLE * (SELECT remain FROM p q WHERE q.k = k0)::DOUBLE / (SELECT wrest FROM p q WHERE q.k = k0)::DOUBLE END AS target
  FROM p, f),
q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.w, round(t.target)::BIGINT AS quota, d.h,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.h, 1, 13), d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, quota // greatest(source_size, 1) AS epochs,
         least(greatest(quota - (quota // greatest(source_size, 1)) * source_size - before, 0), size) AS last FROM q),
x AS (
  SELECT *, epochs * size + last AS taken, w::DOUBLE * before / quota AS area FROM r)
SELECT doc_id, source, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(CASE w
         WHEN 1 THEN 2 * area / (1.5 + sqrt(greatest(2.25 - 2 * area, 0)))
         WHEN 2 THEN area / 2
         ELSE 2 * area / (2 + sqrt(4 + 4 * area)) END, 9) END AS position
FROM x
"""


@register("op1_curriculum_mix", SQL)
def op1_curriculum_mix(spark, sf_dir):
    """Every document's share of the mix, in training order."""
    m = training_order(mix(read(spark, sf_dir, "documents"), curriculum), "doc_id")
    return m.select("doc_id", "source", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
