"""Query op13: periodic runs of words in all documents, some with a planted period."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read, words
from .periodic import periodic_runs
from .registry import register

SQL = r"""
WITH RECURSIVE
c AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::BIGINT)),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) AS h
  FROM documents),
o AS (SELECT doc_id, row_number() OVER () AS r, w, len(w) AS n, h, h // 10 AS g FROM c),
x AS (SELECT *, unnest(range(n)) AS i, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM o),
p AS (
  SELECT r, i AS j, n, CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END AS word FROM x),
s AS (  -- codes of 5 * 2^k words from j on
  SELECT r, j, 5::BIGINT AS m, hash(word, lead(word, 1) OVER t, lead(word, 2) OVER t, lead(word, 3) OVER t, lead(word, 4) OVER t) AS v,
         lead(word, 4) OVER t IS NOT NULL AS whole
  FROM p WINDOW t AS (PARTITION BY r ORDER BY j)
  UNION ALL
  SELECT * FROM (
    SELECT r, j, 2 * m, hash(v, lead(v, m) OVER t), lead(v, m) OVER t IS NOT NULL AS whole FROM s WHERE whole
    WINDOW t AS (PARTITION BY r ORDER BY j)) WHERE whole),
q AS (  -- squares: the nearest equal stretch is no farther than it is long
  SELECT DISTINCT r, d FROM (
    SELECT r, m, j - lag(j) OVER (PARTITION BY r, m, v ORDER BY j) AS d FROM s WHERE whole)
  WHERE d <= m AND (m = 5 OR 2 * d > m)),
e AS (
  SELECT q.r, q.d, b.j, b.j - row_number() OVER (PARTITION BY q.r, q.d ORDER BY b.j) AS island
  FROM q JOIN p b ON b.r = q.r JOIN p a ON a.r = q.r AND a.j = b.j - q.d WHERE a.word = b.word),
f AS (
  SELECT r, d, min(j) - d AS start, count(*) + d AS length FROM e GROUP BY r, d, island HAVING count(*) + d >= greatest(6, 4 * d)),
u AS (SELECT r, start, length, min(d) AS period FROM f GROUP BY r, start, length),
best AS (
  SELECT * FROM u a WHERE NOT EXISTS (
    SELECT 1 FROM u b WHERE b.r = a.r AND (b.length * a.period > a.length * b.period
      OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))))),
k AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM u GROUP BY r),
dropped AS (SELECT DISTINCT u.r, unnest(range(u.start + u.period, u.start + u.length)) AS j FROM u),
l AS (
  SELECT p.r, string_agg(p.word, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN dropped x ON x.r = p.r AND x.j = p.j WHERE x.j IS NULL GROUP BY p.r)
SELECT o.doc_id, coalesce(k.n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
       best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(k.listed, '')) AS runs_sha256, sha256(coalesce(l.kept, '')) AS collapsed_sha256
FROM o LEFT JOIN k ON k.r = o.r LEFT JOIN l ON l.r = o.r LEFT JOIN best ON best.r = o.r
"""


def planted(docs):
    """doc_id and text, a tenth of the texts planted: from a place on, the words that stand there repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # the words are a column of their own: inside the lambda below they would be found anew for every word
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words("text")).alias("w"))
    n, g = F.size("w"), F.col("g")
    a = F.pmod(g, n).cast("int")
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get("w", (a + F.pmod(i, p)).cast("int")))
    repeated = F.array_join(F.concat(F.slice("w", 1, a), tail), " ")
    return split.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs", SQL)
def op13_periodic_runs(spark, sf_dir):
    """Runs of every document: their number, the strongest, digests of all and of the collapsed text."""
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    strongest = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", strongest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
