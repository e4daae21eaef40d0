"""Catalog: dedup and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunking import chunk_items, process_items
from ..operators.dedup import deduplicate, hash_counts, template_hashes
from ..sources.archive import items_all_template, items_long, items_template, items_tie, read_table
from . import sqlplans as P
from .catalog import register

ITEMS_TEMPLATE_SQL = """
SELECT source AS site, doc_id AS ord, substring(text, 1, 60) AS title,
       CASE WHEN doc_id % 5 <= 1 THEN 'tpl ' || source ELSE text END AS content,
       'blog' AS content_type,
       CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '.example/'
            ELSE 'https://' || source || '.example/blog/' || CAST(doc_id AS VARCHAR) END AS source_url
FROM documents
"""

ITEMS_TIE_SQL = """
SELECT 's' || CAST(floor(doc_id / 8) AS BIGINT) AS site, doc_id AS ord, substring(text, 1, 60) AS title,
       CASE WHEN doc_id % 2 = 0 THEN 'tpl A' ELSE 'tpl B' END AS content, 'blog' AS content_type,
       'https://x.example/' || CASE WHEN doc_id % 4 < 2 THEN 'blog/' ELSE '' END || CAST(doc_id AS VARCHAR) AS source_url
FROM documents
"""

ITEMS_ALL_TEMPLATE_SQL = """
SELECT 's' || CAST(floor(doc_id / 5) AS BIGINT) AS site, doc_id AS ord, substring(text, 1, 60) AS title,
       'tpl s' || CAST(floor(doc_id / 5) AS BIGINT) AS content, 'blog' AS content_type,
       'https://x.example/blog/' || CAST(doc_id AS VARCHAR) AS source_url
FROM documents
"""

ITEMS_LONG_SQL = """
SELECT source AS site, doc_id AS ord, substring(text, 1, 60) AS title,
       replace(text, chr(10), chr(10) || chr(10)) AS content, 'blog' AS content_type,
       'https://' || source || '.example/blog/' || CAST(doc_id AS VARCHAR) AS source_url
FROM documents
"""


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# ----------------------------------------------------------------- A1, A2

@register(
    "a1_hash_counts",
    f"""WITH it AS ({ITEMS_TEMPLATE_SQL})
    SELECT site, md5(content) AS content_md5, count(*)::BIGINT AS cnt, min(ord) AS first_ord
    FROM it GROUP BY site, md5(content)""",
)
def a1_hash_counts(spark, sf_dir):
    """C1 + A1: items per (site, md5 of content) with first-seen order."""
    return hash_counts(items_template(_docs(spark, sf_dir)))


@register(
    "a2_template_hashes",
    f"""WITH it AS ({ITEMS_TEMPLATE_SQL}),
    c AS (SELECT site, md5(content) AS h, count(*) AS cnt, min(ord) AS first_ord FROM it GROUP BY site, md5(content)),
    t AS (SELECT site, count(*) AS total FROM it GROUP BY site)
    SELECT c.site, arg_max(h, first_ord) AS template_md5
    FROM c JOIN t ON c.site = t.site
    WHERE cnt > 3 AND cnt >= total * (CASE WHEN total <= 10 THEN 0.5 ELSE 0.3 END)::DOUBLE
    GROUP BY c.site""",
)
def a2_template_hashes(spark, sf_dir):
    """A2: template hash per site (count > 3 and >= 50 % / 30 % of the run)."""
    return template_hashes(items_template(_docs(spark, sf_dir))).select("site", "template_md5")


# ------------------------------------------------------ J6 + W1 + W2

DEDUP_TEMPLATE_SQL = f"""
WITH it AS ({ITEMS_TEMPLATE_SQL}),
{P.dedup('it').strip()}
SELECT site, ord, title, content_md5, source_url FROM deduped
"""


@register("p7_dedup_template", DEDUP_TEMPLATE_SQL)
def p7_dedup_template(spark, sf_dir):
    """J6 template exclusion on blog URLs + W1 first-wins dedup."""
    d = deduplicate(items_template(_docs(spark, sf_dir)))
    return d.select("site", "ord", "title", F.md5("content").alias("content_md5"), "source_url")


DEDUP_TIE_SQL = f"""
WITH it AS ({ITEMS_TIE_SQL}),
{P.dedup('it').strip()}
SELECT site, ord, title, content, source_url FROM deduped
"""


@register("a2_template_tie", DEDUP_TIE_SQL)
def a2_template_tie(spark, sf_dir):
    """A2 tie rule: of two qualifying hashes the last first-seen one is the template."""
    return deduplicate(items_tie(_docs(spark, sf_dir))).select("site", "ord", "title", "content", "source_url")


DEDUP_ALL_SQL = f"""
WITH it AS ({ITEMS_ALL_TEMPLATE_SQL}),
{P.dedup('it').strip()}
SELECT site, ord, title, content FROM deduped
"""


@register("w2_all_template", DEDUP_ALL_SQL)
def w2_all_template(spark, sf_dir):
    """Every item is template on a blog URL -> first item, title marked."""
    return deduplicate(items_all_template(_docs(spark, sf_dir))).select("site", "ord", "title", "content")


# ------------------------------------------------------------- C2, C3, W10

def _chunk_sql(m: int) -> str:
    return f"""
WITH RECURSIVE il AS ({ITEMS_LONG_SQL}),
{P.chunked('il', m).strip()}
SELECT site, ord, part, title, md5(content) AS content_md5, length(content)::BIGINT AS content_len FROM chunked
"""


def _chunk_query(m: int):
    def q(spark, sf_dir):
        c = chunk_items(items_long(_docs(spark, sf_dir)), m)
        return c.select(
            "site", "ord", "part", "title", F.md5("content").alias("content_md5"),
            F.length("content").cast("long").alias("content_len"),
        )

    q.__doc__ = f"C2/C3/W10: paragraph chunking at max {m}."
    return q


register("c2_c3_chunk_2000", _chunk_sql(2000))(_chunk_query(2000))
register("c2_c3_chunk_8000", _chunk_sql(8000))(_chunk_query(8000))


# ------------------------------------------------------------- P7 and A5

PROCESS_SQL = f"""
WITH RECURSIVE it AS ({ITEMS_TEMPLATE_SQL.replace("ELSE text END AS content", "ELSE replace(text, chr(10), chr(10) || chr(10)) END AS content")}),
{P.dedup('it').strip()},
{P.chunked('deduped', 2000).strip()}
SELECT site, ord, part, title, md5(content) AS content_md5, source_url FROM chunked
"""


def _items_template_long(docs):
    it = items_template(docs)
    return it.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))


@register("p7_process", PROCESS_SQL)
def p7_process(spark, sf_dir):
    """Dedup then chunk (max 2,000)."""
    out = process_items(_items_template_long(_docs(spark, sf_dir)), 2000)
    return out.select("site", "ord", "part", "title", F.md5("content").alias("content_md5"), "source_url")


STAGE_SQL = f"""
WITH RECURSIVE it AS ({ITEMS_TEMPLATE_SQL.replace("ELSE text END AS content", "ELSE replace(text, chr(10), chr(10) || chr(10)) END AS content")}),
{P.dedup('it').strip()},
{P.chunked('deduped', 2000).strip()},
a AS (SELECT site, count(*) AS n FROM it GROUP BY site),
b AS (SELECT site, count(*) AS n FROM deduped GROUP BY site),
c AS (SELECT site, count(*) AS n FROM chunked GROUP BY site)
SELECT a.site, a.n::BIGINT AS extracted, coalesce(b.n, 0)::BIGINT AS deduped, coalesce(c.n, 0)::BIGINT AS chunked
FROM a LEFT JOIN b ON a.site = b.site LEFT JOIN c ON a.site = c.site
"""


@register("a5_stage_counts", STAGE_SQL)
def a5_stage_counts(spark, sf_dir):
    """A5: items per site after extraction, dedup and chunking."""
    from ..operators.chunking import chunk_items as _chunk

    items = _items_template_long(_docs(spark, sf_dir))
    dd = deduplicate(items)
    ch = _chunk(dd, 2000)
    a = items.groupBy("site").agg(F.count(F.lit(1)).alias("extracted"))
    b = dd.groupBy("site").agg(F.count(F.lit(1)).alias("deduped"))
    c = ch.groupBy("site").agg(F.count(F.lit(1)).alias("chunked"))
    return (
        a.join(b, "site", "left").join(c, "site", "left")
        .select("site", "extracted", F.coalesce("deduped", F.lit(0)).alias("deduped"),
                F.coalesce("chunked", F.lit(0)).alias("chunked"))
    )

