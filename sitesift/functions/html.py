"""HTML column functions: cleaning, visible text, title and main content.

HTML in a crawl archive is not well-formed, so it is never parsed as XML.
Every step is a regex rewrite or an array fold evaluated inside the JVM; what
depends on nesting goes through the element tree (``functions/tree.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import built_once, col_, decode_entities, strip_tags
from .tree import MAIN, TITLES, first_of, first_text, largest_block, with_tree

# Comments, scripts and styles go first: scripts may hold markup text.
NOISE_RE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
# Hidden parts for visible text.
HEAD_RE = r"(?is)<head\b[^>]*>.*?</head\s*>"

def remove_noise(html) -> Column:
    return F.regexp_replace(col_(html), NOISE_RE, "")


def text_of(fragment) -> Column:
    """``get_text()``: tags dropped, entities decoded."""
    return decode_entities(strip_tags(fragment))


def visible_text(html) -> Column:
    """Text without head, scripts, styles and comments."""
    h = F.regexp_replace(remove_noise(html), HEAD_RE, "")
    return text_of(h)


def with_content(df: DataFrame, html: str, p: str) -> DataFrame:
    """Add ``p``-prefixed columns of the page in column ``html``: the arrays of
    its tree (``tree.with_tree``), main (number of the main element, null if
    none) and block (number of the largest block, null if none)."""
    df = df.select("*", remove_noise(html).alias(p + "clean"))
    df = with_tree(df, p + "clean", p).drop(p + "clean")
    for step in _content_steps(p):
        df = df.select("*", *step)
    return df


@built_once
def _content_steps(p: str) -> list[list[Column]]:
    lens = F.transform(p + "plain", lambda x: F.length(x))
    return [[first_of(p, MAIN)["at"].alias(p + "main"), lens.alias(p + "lens")], [largest_block(p, F.col(p + "lens")).alias(p + "block")]]


@built_once
def page_title(p: str) -> Column:
    """First non-blank of h1, the title classes, <title>, outside the chrome; else 'Untitled'."""
    return F.coalesce(first_text(p, TITLES), F.lit("Untitled"))
