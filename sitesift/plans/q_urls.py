"""Catalog: URL projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import py_strip
from ..sources.archive import read_table
from . import sqlparts as S
from .catalog import register

# URL shapes placed on every page's host (derived candidates).
# (kind, path) -- kind 'www' / 'port' / 'substack' change the host.
CANDIDATE_SHAPES = [
    ("same", "/blog/post-"), ("same", "/tag/"), ("same", "/2024/05/"), ("same", "/products/item/"),
    ("same", "/about-us/"), ("same", "/news/"), ("same", "/x"), ("same", "/static/a/"),
    ("same", "/guides/how-"), ("same", "/democracy/essay/"), ("same", "/p/"), ("same", "/api/v1/"),
    ("same", "/company/blog/"), ("same", "/Blog/Upper-"), ("same", "/blogging/x-"), ("same", "/a/b/c-"),
    ("same", "/data/x.json?v="), ("same", "/how-to-"), ("same", "/blog"), ("same", "/blog/"),
    ("www", "/blog/post-"), ("port", "/blog/post-"), ("substack", "/p/"), ("substack", "/t/"),
    ("substack", "/p/x/comments"), ("same", "/archive/"), ("same", "/post;v=1/"),
]


def _shapes_df(spark):
    # a fixed, tiny dimension: broadcast is size-proof
    return F.broadcast(spark.createDataFrame(CANDIDATE_SHAPES, "kind string, path string"))


def url_candidates(spark, pages):
    """pages x shapes on the page's host -> (page_id, site, url)."""
    p = pages.select("page_id", U.url_scheme("url").alias("scheme"), U.url_netloc("url").alias("site"))
    host = (
        F.when(F.col("kind") == "www", F.concat(F.lit("www."), "site"))
        .when(F.col("kind") == "port", F.concat("site", F.lit(":8080")))
        .when(F.col("kind") == "substack", F.lit("x.substack.com"))
        .otherwise(F.col("site"))
    )
    return p.crossJoin(_shapes_df(spark)).select(
        "page_id", "site", "path",
        F.concat("scheme", F.lit("://"), host, "path", F.col("page_id").cast("string")).alias("url"),
    )


SHAPES_SQL = "(VALUES " + ", ".join(f"({S.q(k)}, {S.q(p)})" for k, p in CANDIDATE_SHAPES) + ") AS sh(kind, path)"

CANDIDATES_SQL = f"""
SELECT page_id, site, path,
  scheme || '://' || CASE WHEN kind = 'www' THEN 'www.' || site WHEN kind = 'port' THEN site || ':8080'
                          WHEN kind = 'substack' THEN 'x.substack.com' ELSE site END
  || path || CAST(page_id AS VARCHAR) AS url
FROM (SELECT page_id, {S.url_scheme('url')} AS scheme, {S.url_netloc('url')} AS site FROM pages) p
CROSS JOIN {SHAPES_SQL}
"""

URL_FILTERS_SQL = f"""
WITH c AS ({CANDIDATES_SQL}),
d AS (SELECT *, {S.url_scheme('url')} || '://' || site || '/blog' AS section_url FROM c)
SELECT page_id, path AS shape, url,
       {S.url_netloc('url')} AS netloc,
       {S.url_path('url')} AS url_path,
       {S.path_depth(S.url_path('url'))}::BIGINT AS depth,
       {S.url_netloc('url')} = site AS same_domain,
       {S.is_content_url('url', 'site')} AS is_content,
       {S.is_section_content_url('url', 'section_url', 'site')} AS is_section_content,
       {S.is_rendered_content_url('url')} AS is_rendered_content,
       {S.is_likely_blog_url('url')} AS is_blog_url,
       {S.route('url')} AS route
FROM d
"""


@register("f1_f6_url_filters", URL_FILTERS_SQL)
def url_filters(spark, sf_dir):
    """U1 netloc/path, U3 lower, U4 depth, F1 content, F2 section, F3 rendered, F4 domain, F5 blog, F6 route."""
    c = url_candidates(spark, read_table(spark, sf_dir, "pages"))
    d = c.withColumn("section_url", F.concat(U.url_scheme("url"), F.lit("://"), "site", F.lit("/blog")))
    return d.select(
        "page_id",
        F.col("path").alias("shape"),
        "url",
        U.url_netloc("url").alias("netloc"),
        U.url_path("url").alias("url_path"),
        U.path_depth(U.url_path("url")).cast("long").alias("depth"),
        U.is_same_domain("url", "site").alias("same_domain"),
        U.is_content_url("url", "site").alias("is_content"),
        U.is_section_content_url("url", "section_url", "site").alias("is_section_content"),
        U.is_rendered_content_url("url").alias("is_rendered_content"),
        U.is_likely_blog_url("url").alias("is_blog_url"),
        U.route("url").alias("route"),
    )


PARTS_SQL = f"""
SELECT page_id, {S.url_scheme('url')} AS scheme, {S.url_netloc('url')} AS netloc, {S.url_path('url')} AS url_path,
       {S.url_query('url')} AS query, {S.url_fragment('url')} AS fragment,
       len({S.path_parts(S.url_path('url'))})::BIGINT AS n_segments
FROM pages
"""


@register("u1_url_parts", PARTS_SQL)
def url_parts(spark, sf_dir):
    """Scheme, exact netloc, path, query, fragment; U4 segment count."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        U.url_scheme("url").alias("scheme"),
        U.url_netloc("url").alias("netloc"),
        U.url_path("url").alias("url_path"),
        U.url_query("url").alias("query"),
        U.url_fragment("url").alias("fragment"),
        F.size(U.path_parts(U.url_path("url"))).cast("long").alias("n_segments"),
    )


# Href shapes resolved against every page URL.
HREF_SHAPES = [
    "", "https://other.example/x/../y", "//cdn.example/p/q", "/p/./q/../r", "?q=1", "#frag", "p", "../p", "./p",
    "a/./b/../c", "mailto:x@example.com", "javascript:void(0)", "../../../../x", ".", "..", "/", "p?x=1#y",
    "http://HOST.example/Path", "HTTPS://other.example/a",
]


@register(
    "u2_url_join",
    f"""
SELECT page_id, href, {S.url_join('url', 'href')} AS full_url
FROM pages CROSS JOIN (VALUES {", ".join(f"({S.q(h)})" for h in HREF_SHAPES)}) AS hs(href)
""",
)
def url_join(spark, sf_dir):
    """Relative references resolved against each page URL."""
    hrefs = F.broadcast(spark.createDataFrame([(h,) for h in HREF_SHAPES], "href string"))
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return p.crossJoin(hrefs).select("page_id", "href", U.url_join("url", "href").alias("full_url"))


_FULL = "CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u ELSE 'https://' || u END"

REQUEST_SQL = f"""
WITH r AS (
  SELECT page_id,
         CASE WHEN page_id % 5 = 0 THEN '  ' WHEN page_id % 5 = 1 THEN regexp_replace(url, '^https?://', '')
              ELSE ' ' || url || ' ' END AS raw_url,
         CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 5 ELSE 50 END AS max_items_in
  FROM pages
),
r2 AS (SELECT page_id, {S.strip('raw_url')} AS u, max_items_in FROM r)
SELECT page_id, u = '' AS rejected,
       CASE WHEN u <> '' THEN {_FULL} END AS url,
       least(coalesce(max_items_in, 10), 20) AS max_items,
       CASE WHEN u <> '' THEN {S.route(_FULL)} END AS route
FROM r2
"""


@register("u5_o2_f20_requests", REQUEST_SQL)
def api_requests(spark, sf_dir):
    """F20 empty-URL rejection, U5 default scheme, O2 item cap min(n or 10, 20), F6 route."""
    p = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    raw = (
        F.when(pid % 5 == 0, F.lit("  "))
        .when(pid % 5 == 1, F.regexp_replace("url", "^https?://", ""))
        .otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    )
    mx = F.when(pid % 3 == 0, F.lit(None).cast("int")).when(pid % 3 == 1, F.lit(5)).otherwise(F.lit(50))
    r = p.select("page_id", py_strip(raw).alias("u"), mx.alias("max_items_in"))
    url = F.when(F.col("u") != "", U.default_scheme("u"))
    return r.select(
        "page_id",
        (F.col("u") == "").alias("rejected"),
        url.alias("url"),
        F.least(F.coalesce("max_items_in", F.lit(10)), F.lit(20)).alias("max_items"),
        F.when(F.col("u") != "", U.route(U.default_scheme("u"))).alias("route"),
    )
