"""Link tables from fetched HTML.

Anchors are pulled out of the noise-free HTML with one regex pass and
exploded with their position; nothing leaves the row until the explode, and
no shuffle is needed. ``from_nav`` marks the copies found inside
nav/header/menu spans, which the navigation job lists first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import remove_noise, text_of
from ..functions.text import decode_entities, py_strip
from ..functions.urls import url_join

# Start tag of an anchor with a link, in double, single or no quotes; an
# anchor ends at its end tag or where the next one starts.
ANCHOR_RE = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>"""
HREF_RE = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ANCHOR_END_RE = r"(?is)</a\s*>.*"
NAV_SPAN_RE = r"(?is)<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|<menu\b[^>]*>.*?</menu\s*>"
# Data attributes holding a URL, in priority order (dataset.href || url || link || slug).
DATA_ATTRS = ["href", "url", "link", "slug"]
DATA_TAG_RE = r"""(?is)<[a-z][a-z0-9]*\s(?:[^>]*?\s)?data-(?:href|url|link|slug)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>"""


def href_of(tag) -> Column:
    return decode_entities(F.concat(*(F.regexp_extract(tag, HREF_RE, g) for g in (1, 2, 3))))


def _anchors(html: str, from_nav: bool) -> Column:
    """Array of (from_nav, a, body): start tag and the HTML up to the anchor's end."""
    parts = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR_RE), F.lit(0)).alias("a"),
                         F.slice(F.split(html, ANCHOR_RE), 2, 1 << 30).alias("body"))
    return F.transform(parts, lambda p: F.struct(
        F.lit(from_nav).alias("from_nav"), p["a"].alias("a"), F.regexp_replace(p["body"], ANCHOR_END_RE, "").alias("body")))


def with_link_array(df: DataFrame, html: str, page_url: str, out: str = "links", with_nav: bool = True) -> DataFrame:
    """Add ``out``: array<struct<from_nav, pos, href, text, full_url>> of the page's anchors.

    With ``with_nav`` the anchors inside nav/header/menu come first
    (``from_nav`` true) followed by every anchor of the page (T2: the two
    lists are concatenated, duplicates kept). Per-link work happens inside
    higher-order functions, so later filters on links never get the URL
    expressions substituted into them.
    """
    t = "__la_"
    d = df.withColumn(t + "clean", remove_noise(F.col(html)))
    all_a = _anchors(t + "clean", False)
    if with_nav:
        d = d.withColumn(t + "nav", F.array_join(F.regexp_extract_all(t + "clean", F.lit(NAV_SPAN_RE), 0), " "))
        d = d.withColumn(t + "raw", F.concat(_anchors(t + "nav", True), all_a))
    else:
        d = d.withColumn(t + "raw", all_a)
    d = d.withColumn(t + "parsed", F.transform(t + "raw", lambda e, i: F.struct(
        e["from_nav"].alias("from_nav"), i.alias("pos"),
        href_of(e["a"]).alias("href"),
        py_strip(text_of(e["body"])).alias("text"))))
    d = d.withColumn(out, F.transform(t + "parsed", lambda e: F.struct(
        e["from_nav"].alias("from_nav"), e["pos"].alias("pos"), e["href"].alias("href"), e["text"].alias("text"),
        url_join(F.col(page_url), e["href"]).alias("full_url"))))
    return d.drop(t + "clean", t + "nav", t + "raw", t + "parsed")


def page_links(df: DataFrame, html: str, page_url: str, keys, with_nav: bool = True) -> DataFrame:
    """One row per anchor: keys..., page_url, from_nav, pos, href, text, full_url."""
    keys = list(keys)
    d = with_link_array(df.select(*keys, F.col(page_url).alias("page_url"), F.col(html).alias("__html")),
                        "__html", "page_url", "__links", with_nav)
    return d.select(*keys, "page_url", F.inline_outer("__links")).where("pos is not null")


def data_attribute_urls(df: DataFrame, html: str, keys) -> DataFrame:
    """Per element with data-href/url/link/slug, the first non-empty value."""
    keys = list(keys)
    tags = F.regexp_extract_all(remove_noise(F.col(html)), F.lit(DATA_TAG_RE), 0)
    x = df.select(*keys, F.posexplode_outer(tags).alias("pos", "tag")).where("pos is not null")
    vals = [
        F.nullif(F.concat(*(F.regexp_extract("tag", r"(?is)\sdata-" + a + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", g)
                            for g in (1, 2, 3))), F.lit("")) for a in DATA_ATTRS
    ]
    return x.select(*keys, "pos", decode_entities(F.coalesce(*vals)).alias("value")).where(F.col("value").isNotNull())
