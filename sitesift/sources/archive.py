"""Archive scans (S1) and the engine tables derived from the driver tables.

The engine works on a crawl archive: ``fetches(site, url, status,
content_type, body, rendered_html, final_url, render_error)`` and
``sites(site, base_url, max_items, chunk_size, use_browser)``. The test
archive is the ``pages`` table; the functions below turn it (and
``documents`` / ``events``) into those engine tables. Every derivation
keeps all rows; the ``% n`` expressions only assign attributes (status,
injected phrases, URL shapes) so that every branch of the operators sees
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_netloc, url_scheme

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


READ_PARTITIONS = "spark.sitesift.readPartitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table, as the session's split settings deal it out. A session
    that reads a few files of one large row group each (bench.py) may set
    ``spark.sitesift.readPartitions`` to have their rows dealt out anew."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def pages_with_site(pages: DataFrame) -> DataFrame:
    """Pages keyed by host (the site)."""
    return pages.select("page_id", "url", "html", url_netloc("url").alias("site"))


def pages_as_fetches(pages: DataFrame) -> DataFrame:
    """The archive as a plain fetch table (status 200, body = html)."""
    return pages.select(
        url_netloc("url").alias("site"),
        F.col("page_id"),
        F.col("url"),
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"),
        F.lit(None).cast("string").alias("rendered_html"),
        F.col("url").alias("final_url"),
        F.lit(None).cast("string").alias("render_error"),
    )


def derived_fetches(pages: DataFrame) -> DataFrame:
    """Fetch table with every gate branch populated (see FIXTURES.md)."""
    pid = F.col("page_id")
    status = (
        F.when(pid % 10 == 0, 404).when(pid % 10 == 1, 500).when(pid % 10 == 2, 204).otherwise(200)
    )
    body = F.col("html")
    body = F.when(pid % 7 == 3, F.concat(body, F.lit(" page not found "))).otherwise(body)
    body = F.when(pid % 7 == 4, F.concat(body, F.lit(" error 404 "))).otherwise(body)
    body = F.when(pid % 11 == 4, F.concat(body, F.lit(" __next "))).otherwise(body)
    body = F.when(pid % 13 == 5, F.substring(body, 1, 500)).otherwise(body)
    rendered = F.when(pid % 3 != 0, F.col("html"))
    return pages.select(
        url_netloc("url").alias("site"),
        pid.alias("page_id"),
        F.col("url"),
        status.alias("status"),
        F.lit("text/html").alias("content_type"),
        body.alias("body"),
        rendered.alias("rendered_html"),
        F.col("url").alias("final_url"),
        F.lit(None).cast("string").alias("render_error"),
    )


def items_from_documents(documents: DataFrame) -> DataFrame:
    """Plain items: one per document, site = source."""
    return documents.select(
        F.col("source").alias("site"),
        F.col("doc_id").alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.lit("blog").alias("content_type"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/blog/"), F.col("doc_id").cast("string")).alias(
            "source_url"
        ),
    )


def items_template(documents: DataFrame) -> DataFrame:
    """Items where two fifths of each site repeat one template text."""
    d = F.col("doc_id")
    content = F.when(d % 5 <= 1, F.concat(F.lit("tpl "), F.col("source"))).otherwise(F.col("text"))
    url = F.when(
        d % 3 == 0, F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"))
    ).otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example/blog/"), d.cast("string")))
    return documents.select(
        F.col("source").alias("site"),
        d.alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        content.alias("content"),
        F.lit("blog").alias("content_type"),
        url.alias("source_url"),
    )


def items_tie(documents: DataFrame) -> DataFrame:
    """Sites of eight items, four 'tpl A' and four 'tpl B': both qualify."""
    d = F.col("doc_id")
    return documents.select(
        F.concat(F.lit("s"), F.floor(d / 8).cast("string")).alias("site"),
        d.alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        F.when(d % 2 == 0, F.lit("tpl A")).otherwise(F.lit("tpl B")).alias("content"),
        F.lit("blog").alias("content_type"),
        F.concat(F.lit("https://x.example/"), F.when(d % 4 < 2, F.lit("blog/")).otherwise(F.lit("")), d.cast("string")).alias(
            "source_url"
        ),
    )


def items_all_template(documents: DataFrame) -> DataFrame:
    """Sites of five items with one text, all on blog URLs."""
    d = F.col("doc_id")
    site = F.concat(F.lit("s"), F.floor(d / 5).cast("string"))
    return documents.select(
        site.alias("site"),
        d.alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("tpl "), site).alias("content"),
        F.lit("blog").alias("content_type"),
        F.concat(F.lit("https://x.example/blog/"), d.cast("string")).alias("source_url"),
    )


def items_long(documents: DataFrame) -> DataFrame:
    """Items whose single line breaks become paragraph breaks."""
    return documents.select(
        F.col("source").alias("site"),
        F.col("doc_id").alias("ord"),
        F.substring("text", 1, 60).alias("title"),
        F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"),
        F.lit("blog").alias("content_type"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/blog/"), F.col("doc_id").cast("string")).alias(
            "source_url"
        ),
    )


# Title words and content additions for the classifier input.
TITLE_WORDS = ["podcast", "call", "book", "update", ""]


def titled_items(documents: DataFrame) -> DataFrame:
    """Classifier input: titles with label words, tutorial cues, platform hosts."""
    d = F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(w) for w in TITLE_WORDS]), (d % 5 + 1).cast("int"))
    title = F.concat(F.substring("text", 1, 60), F.when(word != "", F.concat(F.lit(" "), word)).otherwise(F.lit("")))
    content = (
        F.when(d % 3 == 0, F.concat(F.col("text"), F.lit(" 1. 2. 3. ")))
        .when(d % 3 == 1, F.concat(F.lit("how to "), F.col("text"), F.lit(" guide: ")))
        .otherwise(F.col("text"))
    )
    host = (
        F.when(d % 17 == 0, F.lit("medium.com"))
        .when(d % 19 == 0, F.lit("www.linkedin.com"))
        .when(d % 23 == 0, F.lit("reddit.com"))
        .otherwise(F.concat(F.col("source"), F.lit(".example")))
    )
    return documents.select(
        d.alias("doc_id"),
        F.concat(F.lit("https://"), host, F.lit("/"), F.col("lang"), F.lit("/"), d.cast("string")).alias("url"),
        title.alias("title"),
        content.alias("content"),
    )
