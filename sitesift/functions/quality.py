"""Fetch and content quality gates as boolean Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import visible_text
from .text import col_, collapse_ws, contains_any, count_present, count_substr, py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
# ---------------------------------------------------------------------------
HTML_STRUCTURE_MARKERS = ["<html", "<body"]
CONTENT_MARKERS = ["<p", "<div", "<article", "<main", "<section", "<h1", "<h2", "<h3"]

SPA_MARKERS = [
    "_next/", "next/static", "__next",
    "nuxt", "_nuxt/",
    "react", "vue", "angular",
    "app-root", "root-app",
    "webpack", "bundle.js",
]
SPA_ERROR_PHRASES = [
    "greetings flesh bag",
    "error 404", "404 error",
    "this page could not be found",
    "page does not exist",
]
STRONG_ERROR_PHRASES = [
    "greetings flesh bag",
    "error 404", "404 error",
    "page not found", "file not found",
    "this page could not be found",
    "page does not exist", "content not available",
    "page unavailable",
]
WEAK_ERROR_WORDS = ["404", "not found", "oops", "something went wrong"]
TITLE_ERROR_PHRASES = [
    "greetings flesh bag", "404 error", "page not found",
    "file not found", "error 404",
    "this page could not be found", "content not available",
    "page does not exist", "page unavailable",
]

MIN_BODY_BYTES = 1000        # smaller bodies go to the rendered copy
SPA_VISIBLE_MAX = 1000       # SPA error text must be shorter than this
WEAK_ERROR_MAX = 300         # weak words count only on pages shorter than this
ITEM_MIN_CHARS = 200         # an accepted item must exceed this (stripped)


def is_valid_html(html) -> Column:
    """Has <html or <body, and at least two distinct content markers."""
    low = F.lower(col_(html))
    script_count = count_substr(low, "<script")
    n = count_present(low, CONTENT_MARKERS)
    # The script clause is kept for fidelity; it never changes the outcome.
    return contains_any(low, HTML_STRUCTURE_MARKERS) & (n >= 2) & ((script_count == 0) | (n >= 1))


def is_spa(html) -> Column:
    return contains_any(F.lower(col_(html)), SPA_MARKERS)


def is_error_content(content, title) -> Column:
    """Extracted item that still looks like an error page."""
    c = F.lower(col_(content))
    t = F.lower(col_(title))
    short = (F.length(py_strip(col_(content))) < 200) & (c.contains("greetings flesh bag") | c.contains("error 404"))
    return contains_any(t, TITLE_ERROR_PHRASES) | short | (c.contains("greetings flesh bag") & c.contains("404 error"))


def with_error_page(df: DataFrame, html: str, out: str) -> DataFrame:
    """Error page test on raw HTML (SPA branch on visible text, else phrases);
    each heavy text is computed once per row."""
    t = "__ep_"
    h = F.col(html)
    df = df.withColumn(t + "low", F.lower(h))
    low = F.col(t + "low")
    df = df.withColumn(t + "spa", contains_any(low, SPA_MARKERS))
    # visible text only for SPA pages, collapsed text only for the others
    df = df.withColumn(t + "vis", F.when(F.col(t + "spa"), F.lower(visible_text(h))))
    df = df.withColumn(t + "col", F.when(~F.col(t + "spa"), collapse_ws(low)))
    vis, col = F.col(t + "vis"), F.col(t + "col")
    spa_error = contains_any(vis, SPA_ERROR_PHRASES) & (F.length(py_strip(vis)) < SPA_VISIBLE_MAX)
    normal_error = contains_any(low, STRONG_ERROR_PHRASES) | (
        (F.length(col) < WEAK_ERROR_MAX) & contains_any(col, WEAK_ERROR_WORDS)
    )
    df = df.withColumn(out, F.when(h.isNull(), F.lit(None)).when(F.col(t + "spa"), spa_error).otherwise(normal_error))
    return df.drop(t + "low", t + "spa", t + "vis", t + "col")


def with_fetch_gate(df: DataFrame, status: str, body: str, out: str) -> DataFrame:
    """Route of one fetched page.

    'drop'   - status >= 400 (404 included): no fallback;
    'error'  - status 200 and an error page: no fallback;
    'small'  - status 200, body under 1,000 bytes: rendered copy;
    'invalid'- status 200, not valid HTML: rendered copy;
    'extract'- status 200 and usable;
    'other'  - any other status (redirects, 204 ...), or none: rendered copy.
    """
    t = "__fg_"
    s = F.col(status)
    # error-page text work only for status 200 rows
    df = df.withColumn(t + "b200", F.when(s == 200, F.col(body)))
    df = with_error_page(df, t + "b200", t + "err")
    gate = (
        F.when(s >= 400, F.lit("drop"))
        .when(s.isNull() | (s != 200), F.lit("other"))  # no answer: only the rendered copy is left
        .when(F.col(t + "err"), F.lit("error"))
        .when(F.octet_length(body) < MIN_BODY_BYTES, F.lit("small"))
        .when(~is_valid_html(body), F.lit("invalid"))
        .otherwise(F.lit("extract"))
    )
    return df.withColumn(out, gate).drop(t + "err", t + "b200")
