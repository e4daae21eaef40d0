"""Query op12: the Merkle manifest of all documents, every row verified against the root."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import ascii_lower, read
from .merkle import folded_root, manifest, proof_digest, record_digest
from .registry import register

#: What a leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SQL = r"""
WITH RECURSIVE
c AS (
  SELECT doc_id, source, lang, n_chars, text, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::BIGINT)),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) AS crc
  FROM documents),
f AS (
  SELECT doc_id, source, text, coalesce(crc % 5 = 0, false) AS tamper,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM c),
d AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tamper THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM f),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n,
         count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
t AS (
  SELECT tree, 0 AS lvl, n, size, leaf AS digest FROM l
  UNION ALL
  SELECT tree, lvl + 1, n // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY n))
  FROM t WHERE size > 1 GROUP BY tree, lvl, n // 16, size),
u AS (
  SELECT 0 AS lvl, tree AS n, (SELECT count(*) FROM t WHERE size = 1) AS size, digest FROM t WHERE size = 1
  UNION ALL
  SELECT lvl + 1, n // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY n)) FROM u WHERE size > 1 GROUP BY lvl, n // 16, size),
ts AS (
  SELECT a.tree, a.lvl, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.n) FILTER (b.n < a.n), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.n) FILTER (b.n > a.n), '') AS after
  FROM t a JOIN t b ON a.tree = b.tree AND a.lvl = b.lvl AND a.n // 16 = b.n // 16 WHERE a.size > 1 GROUP BY a.tree, a.lvl, a.n),
us AS (
  SELECT a.lvl, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.n) FILTER (b.n < a.n), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.n) FILTER (b.n > a.n), '') AS after
  FROM u a JOIN u b ON a.lvl = b.lvl AND a.n // 16 = b.n // 16 WHERE a.size > 1 GROUP BY a.lvl, a.n),
w AS (
  SELECT tree, n, 0 AS lvl, n AS at, coalesce(other, leaf) AS acc, '' AS sibs FROM l
  UNION ALL
  SELECT w.tree, w.n, w.lvl + 1, w.at // 16, sha256(before || acc || after), sibs || before || after
  FROM w JOIN ts ON ts.tree = w.tree AND ts.lvl = w.lvl AND ts.n = w.at),
x AS (
  SELECT tree, n, 0 AS lvl, tree AS at, acc, sibs FROM (SELECT *, max(lvl) OVER (PARTITION BY tree, n) AS high FROM w) WHERE lvl = high
  UNION ALL
  SELECT x.tree, x.n, x.lvl + 1, x.at // 16, sha256(before || acc || after), sibs || before || after
  FROM x JOIN us ON us.lvl = x.lvl AND us.n = x.at),
y AS (SELECT * FROM (SELECT *, max(lvl) OVER (PARTITION BY tree, n) AS high FROM x) WHERE lvl = high)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(y.sibs) AS proof_sha256, y.acc AS folded_root,
       y.acc = r.digest AS verified
FROM l JOIN y ON y.tree = l.tree AND y.n = l.n
JOIN (SELECT tree, digest FROM t WHERE size = 1) s ON s.tree = l.tree, (SELECT digest FROM u WHERE size = 1) r
"""


@register("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark, sf_dir):
    """Every document's leaf, proof and the root it folds to, a fifth of the texts tampered with."""
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
        record_digest(*[ascii_lower(c) if c == "text" else F.col(c) for c in FIELDS]),
    )
    m = manifest(read(spark, sf_dir, "documents"), FIELDS, also={"tampered": tampered})
    folded = folded_root(F.coalesce("tampered", "leaf"), F.col("path"))
    return m.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
