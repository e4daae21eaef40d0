"""Page extraction (P6): gates, title, main content, markdown, class.

One map-only pass over the fetch table (no shuffle). The HTTP copy is tried
first; the rendered copy is only worked on for rows whose HTTP copy failed
and whose gate allows a fallback. Each heavy array of a page's tree is its own
projection, so nothing is evaluated twice for a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import title_or_markdown, with_content_type
from ..functions.html import page_title, with_content
from ..functions.quality import ITEM_MIN_CHARS, is_error_content, with_error_page, with_fetch_gate
from ..functions.text import py_strip
from ..functions.tree import with_markdown

ITEM_FIELDS = ["title", "content", "content_type", "source_url"]


def with_extracted(df: DataFrame, html: str, prefix: str) -> DataFrame:
    """Add ``{prefix}title`` / ``{prefix}content`` / ``{prefix}ok`` for one HTML copy.

    Precise extractor: <main>, <article>, then the content selectors. Lenient
    extractor: the outermost div/section with the longest text, only tried
    when the precise one yields nothing. The first with over 200 stripped
    characters wins (H7). ``ok`` also rejects error-like items (F13).
    """
    p, t = prefix, "__t_"  # the same names for both copies: their expressions are built once
    df = with_content(df, html, t)
    accepted = lambda c: F.when(F.length(py_strip(F.col(c))) > ITEM_MIN_CHARS, F.col(c))
    df = with_markdown(df, t, t + "main", t + "precise")
    df = df.select("*", accepted(t + "precise").alias(t + "first"))
    df = df.select("*", F.when(F.col(t + "first").isNull(), F.col(t + "block")).alias(t + "second"))
    df = with_markdown(df, t, t + "second", t + "lenient")
    df = df.select("*", F.coalesce(t + "first", accepted(t + "lenient")).alias(p + "content"))
    df = df.select("*", F.when(F.col(p + "content").isNotNull(), page_title(t)).alias(t + "title"))
    df = df.select("*", F.nullif(t + "title", F.lit("Untitled")).alias(t + "own"))
    title = title_or_markdown(t + "own", p + "content")
    df = df.select("*", F.when(F.col(p + "content").isNotNull(), title).alias(p + "title"))
    df = df.select("*", (
        F.col(p + "content").isNotNull() & ~F.coalesce(is_error_content(F.col(p + "content"), F.col(p + "title")), F.lit(False))
    ).alias(p + "ok"))
    return df.drop(*(c for c in df.columns if c.startswith(t)))


def extract(fetches: DataFrame, use_browser=True) -> DataFrame:
    """fetches -> one row per fetch with gate, source and (nullable) item.

    ``use_browser`` is a bool or the name of a boolean column (per-site).
    """
    ub = F.lit(bool(use_browser)) if isinstance(use_browser, bool) else F.col(use_browser)
    keep = [c for c in fetches.columns if c not in ("body", "rendered_html", "render_error")]
    df = with_fetch_gate(fetches, "status", "body", "gate")
    df = df.withColumn("__http_html", F.when(F.col("gate") == "extract", F.col("body")))
    df = with_extracted(df, "__http_html", "__h_")
    can_render = (
        ub
        & ~F.col("gate").isin("drop", "error")
        & ~F.col("__h_ok")
        & F.col("rendered_html").isNotNull()
        & (F.col("rendered_html") != "")
        & F.col("render_error").isNull()
    )
    df = df.withColumn("__r_try", F.when(can_render, F.col("rendered_html")))
    df = with_error_page(df, "__r_try", "__r_err")
    df = df.withColumn("__r_html", F.when(~F.col("__r_err"), F.col("__r_try")))
    df = with_extracted(df, "__r_html", "__r_")
    df = df.withColumn(
        "source", F.when(F.col("__h_ok"), F.lit("http")).when(F.col("__r_ok"), F.lit("rendered"))
    )
    df = df.withColumn(
        "__title", F.when(F.col("__h_ok"), F.col("__h_title")).when(F.col("__r_ok"), F.col("__r_title"))
    ).withColumn(
        "__content", F.when(F.col("__h_ok"), F.col("__h_content")).when(F.col("__r_ok"), F.col("__r_content"))
    )
    df = with_content_type(df, "url", "__title", "__content", "__ctype")
    item = F.when(
        F.col("source").isNotNull(),
        F.struct(
            F.col("__title").alias("title"),
            F.col("__content").alias("content"),
            F.col("__ctype").alias("content_type"),
            F.col("url").alias("source_url"),
        ),
    )
    return df.select(*keep, "gate", "source", item.alias("item"))


def items_of(extracted: DataFrame, keys=("site", "ord")) -> DataFrame:
    """drop fetches without an item; flatten the item struct.

    Written as a generator over a zero-or-one element array rather than a
    filter: a filter on ``item`` would be pushed below the staged
    projections with every alias substituted into it.
    """
    keep = [k for k in keys if k in extracted.columns]
    return extracted.select(*keep, F.inline_outer(F.array_compact(F.array("item")))).where("content is not null")
