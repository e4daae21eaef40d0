"""A crawl archive over a page table: every page under its own URL, and for
every site the documents that lead to its pages.

A site is a scheme and host. Its documents are aggregates over all its URLs:
sitemap files of a bounded number of URLs each (a large site has many, by
ranges of the URL's hash, listed in an index), and for smaller sites feeds, a
section page, a home page with links, a navigation page, or a rendered home
page with an API response. Which of them a site publishes follows from the
hash of its root, so that each way of discovery meets sites that have no
other. Page bodies are never grouped; documents hold URLs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_netloc, url_scheme
from ..session import cut_lineage

#: What a site publishes: hash of its root modulo the number of kinds.
KINDS = ("sitemap", "robots", "feed", "atom_and_sitemap", "section", "home", "navigation", "rendered")
#: Sites of more URLs publish sitemaps only: no other document may list so many.
LARGE = 10_000
#: URLs in one sitemap file, about.
PER_FILE = 10_000
DOCUMENT = "struct<path:string,content_type:string,body:string,rendered_html:string,from_home:boolean>"


def hash_of(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the text's MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _escaped(text: Column) -> Column:
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = F.replace(text, F.lit(raw), F.lit(f"&{name};"))
    return text


def _all(urls: Column, each, around: tuple[str, str]) -> Column:
    return F.concat(F.lit(around[0]), F.array_join(F.transform(urls, each), ""), F.lit(around[1]))


def _urlset(urls: Column) -> Column:
    def entry(u):
        day = F.when(u["day"].isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format(u["day"], "yyyy-MM-dd"), F.lit("T10:00:00+00:00</lastmod>")))
        return F.concat(F.lit("<url><loc>"), _escaped(u["url"]), F.lit("</loc>"), F.coalesce(day, F.lit("")), F.lit("</url>"))

    return _all(urls, entry, ('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"))


def _rss(urls: Column) -> Column:
    item = lambda u: F.concat(F.lit("<item><title>t</title><link>"), _escaped(u["url"]), F.lit("</link></item>"))
    return _all(urls, item, ('<rss version="2.0"><channel><title>f</title>', "</channel></rss>"))


def _atom(urls: Column) -> Column:
    entry = lambda u: F.concat(F.lit('<entry><title>t</title><link href="'), _escaped(u["url"]), F.lit('"/></entry>'))
    return _all(urls, entry, ('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>', "</feed>"))


def _html(*parts) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>Site</title></head><body>"),
                    *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</body></html>"))


def _within(url: Column, root: Column) -> Column:
    """A URL as its site's pages link to it: from the root on."""
    return F.concat(F.lit("/"), F.substr(url, F.length(root) + 1))


def _links(urls: Column, root: Column) -> Column:
    """Links as a page has them, escaped."""
    def link(u):
        return F.concat(F.lit('<li><a href="'), _escaped(_within(u["url"], root)), F.lit('">Page</a></li>'))

    return _all(urls, link, ("<ul>", "</ul>"))


def _raw_links(urls: Column, root: Column) -> Column:
    """Links that a script writes: not escaped."""
    return _all(urls, lambda u: F.concat(F.lit('<a href="'), _within(u["url"], root), F.lit('">Page</a>')), ("<div>", "</div>"))


def _document(path: str, content_type: str, body: Column, rendered: Column | None = None, from_home: bool = False) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(path).alias("path"), F.lit(content_type).alias("content_type"), body.alias("body"),
                    (none if rendered is None else rendered).alias("rendered_html"), F.lit(from_home).alias("from_home")).cast(DOCUMENT)


def _small_documents(urls: Column, root: Column) -> Column:
    """Array of the documents of a site that is not large."""
    kind = F.col("kind")
    home = _document("", "text/html", _html(_raw_links(urls, root), '<script>var more = {"href": "/articles/all-of-them", "x": 1}</script>'))
    shell = _html('<div id="app"></div>')
    rendered = _html(
        _links(F.filter(urls, lambda u: u["x"] % 3 == 0), root),
        _all(F.filter(urls, lambda u: u["x"] % 3 == 1), lambda u: F.concat(F.lit('<div data-url="'), _escaped(u["url"]), F.lit('">Page</div>')), ("", "")),
    )
    api = F.to_json(F.struct(
        F.lit("/robots").alias("self"),
        F.transform(F.filter(urls, lambda u: u["x"] % 3 == 2), lambda u: F.struct(F.struct(u["url"].alias("url"), F.lit(1).alias("n")).alias("page"))).alias("items"),
    ))
    return (
        F.when(kind == "feed", F.array(_document("feed", "application/rss+xml", _rss(urls)), home))
        .when(kind == "atom_and_sitemap", F.array(_document("atom.xml", "application/atom+xml", _atom(urls))))
        .when(kind == "section", F.array(_document("blog", "text/html", _html(_links(urls, root)))))
        .when(kind == "home", F.array(home))
        .when(kind == "navigation", F.array(
            _document("", "text/html", _html('<nav><a href="/all-pages">Articles</a></nav>')),
            _document("all-pages", "text/html", _html(_links(urls, root)))))
        .when(kind == "rendered", F.array(
            _document("", "text/html", shell, rendered), _document("api/pages", "application/json", api, from_home=True)))
    )


def site_root(url: str) -> Column:
    """``scheme://host/`` of a URL, empty without one of them."""
    scheme, host = url_scheme(url), url_netloc(url)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.lit("/"))).otherwise("")


def first_copies(pages: DataFrame) -> DataFrame:
    """``pages`` without later copies of a URL; only ids and URLs are grouped."""
    copies = pages.groupBy("url").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = pages.select("url", "page_id").join(copies, "url").where("page_id <> first").select("page_id")
    return pages.join(later, "page_id", "left_anti")


def site_archive(pages: DataFrame, *, large: int = LARGE, per_file: int = PER_FILE, max_items: int | None = None,
                 chunk_size: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(sites, fetches) of a table page_id, url, html.

    Pages without a host belong to no site and are only reached by their URL;
    of several pages with one URL the first counts. A site's documents never
    replace a page of the same URL.
    """
    kept = first_copies(pages)
    urls = kept.select("url", site_root("url").alias("root"), hash_of(F.col("url"), 8).alias("x")).where("root <> ''")
    urls = urls.withColumn("day", F.when(F.col("x") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("x") % 90).cast("int"))))
    counted = urls.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    code = hash_of(F.col("root"), 6)
    kinds = F.array(*map(F.lit, KINDS))
    counted = cut_lineage(counted.select(
        "root", F.ceil(F.col("n") / per_file).alias("files"),
        F.element_at(kinds, (F.when(F.col("n") > large, code % 2).otherwise(code % len(KINDS)) + 1).cast("int")).alias("kind"),
    ))
    sites = counted.select(
        F.col("root").alias("site"), F.col("root").alias("base_url"), F.lit(max_items).cast("int").alias("max_items"),
        F.lit(chunk_size).alias("chunk_size"), F.lit(True).alias("use_browser"))

    listed = urls.join(counted, "root")
    ordered = F.array_sort(F.collect_list(F.struct("url", "day", "x")))
    mapped = F.col("kind").isin("sitemap", "robots") | ((F.col("kind") == "atom_and_sitemap") & (F.col("x") % 2 == 0))
    main = (F.when(F.col("kind") == "sitemap", F.lit("sitemap.xml")).when(F.col("kind") == "robots", F.lit("maps/extra.xml"))
            .otherwise(F.lit("sitemap_index.xml")))
    file = F.floor(F.col("x") * F.col("files") / F.lit(float(1 << 32)))
    files = (
        listed.where(mapped).groupBy("root", "kind", "files", file.alias("file")).agg(ordered.alias("urls"))
        .select("root", F.when(F.col("files") == 1, main).otherwise(F.concat(F.lit("maps/sitemap-"), "file", F.lit(".xml"))).alias("path"),
                F.lit("application/xml").alias("content_type"), _urlset(F.col("urls")).alias("body"))
    )
    child = lambda i: F.concat(F.lit("<sitemap><loc>"), "root", F.lit("maps/sitemap-"), i.cast("string"), F.lit(".xml</loc></sitemap>"))
    with_map = counted.where(F.col("kind").isin("sitemap", "robots", "atom_and_sitemap"))
    indexes = with_map.where("files > 1").select(
        "root", main.alias("path"), F.lit("application/xml").alias("content_type"),
        _all(F.sequence(F.lit(0).cast("long"), F.col("files") - 1), child,
             ('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</sitemapindex>")).alias("body"))
    robots = with_map.where("kind = 'robots'").select(
        "root", F.lit("robots.txt").alias("path"), F.lit("text/plain").alias("content_type"),
        F.concat(F.lit("User-agent: *\nDisallow: /private\nSITEMAP: "), "root", F.lit("maps/extra.xml\n sitemap: ignored\n")).alias("body"))
    small = listed.where(~F.col("kind").isin("sitemap", "robots")).groupBy("root", "kind").agg(ordered.alias("urls"))
    small = small.select("root", F.inline(_small_documents(F.col("urls"), F.col("root"))))
    plain = files.unionByName(indexes).unionByName(robots).withColumns(
        {"rendered_html": F.lit(None).cast("string"), "from_home": F.lit(False)})
    documents = plain.unionByName(small).withColumn("url", F.concat("root", "path"))
    documents = cut_lineage(documents.join(kept.select("url"), "url", "left_anti"))

    def fetch(df: DataFrame, body: str, rendered: Column, content_type: Column, page_url: Column) -> DataFrame:
        return df.select("url", F.lit(200).alias("status"), content_type.alias("content_type"), F.col(body).alias("body"),
                         rendered.alias("rendered_html"), F.lit(None).cast("string").alias("render_error"), page_url.alias("page_url"))

    none = F.lit(None).cast("string")
    fetches = fetch(kept, "html", none, F.lit("text/html"), none).unionByName(
        fetch(documents, "body", F.col("rendered_html"), F.col("content_type"), F.when(F.col("from_home"), F.col("root"))))
    return sites, fetches
