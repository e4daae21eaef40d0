"""URL discovery over a crawl archive.

Every site's fixed probe URLs (sitemaps, robots.txt, feeds, section paths,
home page) are generated with an ``explode`` of a literal array and looked
up in the fetch table with ONE equi-join on ``url`` (``lookup_url``: no body
moves that nobody asked for). Child sitemaps and navigation sections need a
second lookup of the same shape.

All rows are kept unless a ``Limits`` argument says otherwise. Generators are
outer ones with a filter on the generated column: Spark pushes an inner
generator's non-empty test below the staged projections, every alias inlined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from ..functions.text import PY_WHITESPACE
from ..session import cut_lineage
from .links import data_attribute_urls, with_link_array
from .lookup import lookup_url
from .order import number_within

# Source priority used for the documented candidate order.
SOURCE_PRIORITY = {"direct": 0, "sitemap": 1, "feed": 2, "section": 3, "spa": 4, "navigation": 5, "rendered": 6}
WATERFALL_MIN = 5            # run the next source only while fewer URLs are known


@dataclass(frozen=True)
class Limits:
    """Optional bounds of a discovery run; None means all rows."""

    sitemap_chars: int | None = None     # longer sitemap documents are not read (F15)
    sitemap_tags: int | None = None      # url tags read per sitemap document
    sitemap_keep: int | None = None      # newest entries kept per sitemap document (W3)
    sitemap_children: int | None = None  # child sitemaps read per index (W4)
    child_stop: int | None = None        # an index reads no more children after this many URLs (W6)
    nav_sections: int | None = None      # navigation sections looked up per home page (W7)
    loose_links: int | None = None       # loose links taken where a section has no strict one (W8)


ALL = Limits()
# The bounds of the one-site profile.
SINGLE_SITE = Limits(10_000_000, 2000, 100, 3, 1000, 3, 10)

# Patterns and words of links in page scripts and API responses.
SPA_HREF_RES = [r'(?i)href="([^"]*(?:blog|article|post)[^"]*)"', r'(?i)href="(/[^"]*)"']
SPA_JSON_RE = r'"href":\s*"([^"]*)"'
SPA_JSON_WORDS = ["blog", "article", "post"]
API_URL_SUFFIXES = [".json", "/api/", "/graphql"]


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def probe_table(sites: DataFrame) -> DataFrame:
    """(site, domain, base_url, role, probe_idx, url) for every fixed probe of every site."""
    probes = (
        [("sitemap", p) for p in U.SITEMAP_PROBES[:2]]
        + [("robots", U.SITEMAP_PROBES[2])]
        + [("feed", p) for p in U.FEED_PROBES]
        + [("section", p) for p in U.SECTION_PROBES]
    )
    arr = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).alias("probe_idx"), F.lit(p).alias("path"))
                    for i, (r, p) in enumerate(probes)])
    s = sites.select("site", "base_url", U.url_netloc("base_url").alias("domain"))
    x = s.select("site", "base_url", "domain", F.explode(arr).alias("p"))
    x = x.select("site", "base_url", "domain", F.col("p.role").alias("role"), F.col("p.probe_idx").alias("probe_idx"),
                 U.url_join(F.col("base_url"), F.col("p.path")).alias("url"))
    home = s.select("site", "base_url", "domain", F.lit("home").alias("role"), F.lit(-1).alias("probe_idx"),
                    F.col("base_url").alias("url"))
    return x.unionByName(home)


def lookup(requests: DataFrame, fetches: DataFrame, ok_only: bool = True) -> DataFrame:
    """Equi-join requested URLs with the archive (status 200 if ok_only)."""
    f = fetches.select("url", "status", "body", "rendered_html", "render_error")
    if ok_only:
        f = f.where(F.col("status") == 200)
    return lookup_url(requests, f)


# ----------------------------------------------------------------- sitemaps

SITEMAP_SCHEMA = "url array<struct<loc: string, lastmod: string>>, sitemap array<struct<loc: string>>"


def parse_lastmod(c) -> F.Column:
    """Date part before 'T', strict yyyy-M-d, else NULL."""
    d = F.split(F.col(c) if isinstance(c, str) else c, "T").getItem(0)
    return F.to_date(F.try_to_timestamp(d, F.lit("yyyy-M-d")))


def parse_sitemap(docs: DataFrame, keys, limits: Limits = ALL) -> DataFrame:
    """Urlset entries and index children of each document, parsed once.

    Returns keys..., kind ('url'|'child'), pos, loc, lastmod. Documents that
    cannot be parsed, or are longer than ``limits`` allow (F15), give no rows.
    """
    keys = list(keys)
    if limits.sitemap_chars is not None:
        docs = docs.where(F.length("body") <= limits.sitemap_chars)
    d = docs.select(*keys, F.from_xml(F.col("body"), SITEMAP_SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))
    entry = "array<struct<kind:string,pos:int,loc:string,lastmod:string>>"

    def listed(column: str, kind: str, most: int | None):
        found = F.col(column) if most is None else F.slice(F.col(column), 1, most)
        rows = F.transform(found, lambda e, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), e["loc"].alias("loc"),
            (e["lastmod"] if kind == "url" else F.lit(None).cast("string")).alias("lastmod")))
        return F.coalesce(rows, F.array()).cast(entry)

    entries = F.concat(listed("x.url", "url", limits.sitemap_tags), listed("x.sitemap", "child", limits.sitemap_children))
    x = d.select(*keys, F.inline_outer(entries)).where("kind is not null")
    x = x.select(*keys, "kind", "pos", F.btrim("loc", F.lit(PY_WHITESPACE)).alias("loc"), parse_lastmod(F.col("lastmod")).alias("lastmod"))
    return x.where(F.col("loc").isNotNull() & (F.col("loc") != ""))


def sitemap_entries(entries: DataFrame, doc_keys, limits: Limits = ALL) -> DataFrame:
    """Per document, content URLs (F1) ranked newest first, cut if ``limits`` say so.

    Ties keep document order; a missing date counts as 1900-01-01.
    """
    doc_keys = list(doc_keys)
    e = entries.where((F.col("kind") == "url") & U.is_content_url(F.col("loc"), F.col("domain")))
    w = Window.partitionBy(*doc_keys).orderBy(
        F.coalesce("lastmod", F.lit("1900-01-01").cast("date")).desc(), F.col("pos").asc()
    )
    ranked = e.withColumn("rank", F.row_number().over(w))
    return ranked if limits.sitemap_keep is None else ranked.where(F.col("rank") <= limits.sitemap_keep)


def robots_sitemaps(robots: DataFrame, keys) -> DataFrame:
    """S4: 'sitemap:' lines (any case) of robots.txt -> sitemap URL after the first ':'."""
    keys = list(keys)
    lines = robots.select(*keys, F.posexplode_outer(F.split("body", "\n")).alias("line_no", "line"))
    return lines.where(F.lower("line").startswith("sitemap:")).select(
        *keys, "line_no",
        F.btrim(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1), F.lit(PY_WHITESPACE)).alias("loc"),
    )


def discover_sitemaps(probes: DataFrame, fetches: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Sitemap source: /sitemap.xml, /sitemap_index.xml, robots.txt references,
    and the children of indexes, level by level until no new one is stored
    (J3, W4, W6). Each level is written once; a document that a branch has
    already read ends there, so indexes may name each other."""
    docs = probes.where(F.col("role").isin("sitemap", "robots"))
    robots = robots_sitemaps(docs.where(F.col("role") == "robots"), ["site", "domain", "probe_idx"])
    keys = ["site", "domain", "branch", "path", "url"]
    level0 = docs.where(F.col("role") == "sitemap").select(
        "site", "domain", F.col("probe_idx").cast("long").alias("branch"), F.array().cast("array<int>").alias("path"), "url", "body"
    )
    robot_docs = lookup(
        robots.select("site", "domain", (F.lit(1 << 40) * (F.col("probe_idx") + 1) + F.col("line_no")).alias("branch"),
                      F.array().cast("array<int>").alias("path"), F.col("loc").alias("url")),
        fetches,
    ).select(*keys, "body")
    found = read = None
    frontier = level0.unionByName(robot_docs)
    while True:
        entries = cut_lineage(parse_sitemap(frontier, keys, limits))
        if found is not None and entries.isEmpty():
            break
        urls = sitemap_entries(entries, ["site", "branch", "path", "url"], limits).select(
            "site", "branch", "path", "rank", F.col("loc").alias("cand"), "lastmod")
        found = urls if found is None else found.unionByName(urls)
        here = entries.select("site", "branch", "url").distinct()
        read = here if read is None else read.unionByName(here)
        kids = entries.where(F.col("kind") == "child").select(
            "site", "domain", "branch", F.array_append("path", F.col("pos")).alias("path"), F.col("loc").alias("url"))
        frontier = lookup(kids.join(read, ["site", "branch", "url"], "left_anti"), fetches).select(*keys, "body")
    if limits.child_stop is not None:
        found = apply_child_stop(cut_lineage(found), limits.child_stop)
    return found.select("site", F.lit("sitemap").alias("source"), F.col("cand").alias("url"), "lastmod",
                        F.struct("branch", "path", "rank").alias("src_order"))


def apply_child_stop(found: DataFrame, stop: int) -> DataFrame:
    """An index stops reading children once more than ``stop`` URLs came
    from the children read so far; later children (and their subtrees) drop.

    ``path`` is the chain of child positions. Each row is counted once for
    every child node on its chain; a node is cut when its earlier siblings'
    subtree totals exceed the limit.
    """
    levels = F.sequence(F.lit(1), F.size("path"))
    chain = F.when(F.size("path") > 0, F.transform(levels, lambda k: F.slice("path", 1, k)))
    nodes = found.select("site", "branch", F.explode_outer(chain).alias("node")).where("node is not null")
    sub = nodes.groupBy("site", "branch", "node").agg(F.count(F.lit(1)).alias("n"))
    sub = sub.withColumn("parent", F.slice("node", 1, F.size("node") - 1)).withColumn("pos", F.element_at("node", -1))
    w = Window.partitionBy("site", "branch", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cut = sub.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") > stop)
    cut = cut.select("site", "branch", F.col("node").alias("cut_node"))
    # a row is dropped when any node on its chain was cut
    rows = found.withColumn("cut_node", F.explode_outer(chain)).join(cut.withColumn("hit", F.lit(True)), ["site", "branch", "cut_node"], "left")
    order = ["site", "branch", "path", "rank", "cand", "lastmod"]
    kept = rows.groupBy(*order).agg(F.count("hit").alias("hits"))
    return kept.where("hits = 0").select(*order)


# -------------------------------------------------------------------- feeds

_ITEM = "array<struct<link: string, guid: struct<_VALUE: string, _isPermaLink: string>>>"
FEED_SCHEMA = f"channel struct<item: {_ITEM}>, item {_ITEM}, entry array<struct<link: array<struct<_href: string, _rel: string>>>>"


def discover_feeds(probes: DataFrame) -> DataFrame:
    """RSS and RDF item links (else a guid that is a permalink) and Atom
    entry links (an alternate one first); no domain or content filter."""
    def item_link(i):
        guid = F.when(F.lower(F.coalesce(i["guid"]["_isPermaLink"], F.lit("true"))) != "false", i["guid"]["_VALUE"])
        return F.coalesce(F.nullif(F.btrim(i["link"], F.lit(PY_WHITESPACE)), F.lit("")), guid)

    def entry_link(e):
        alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])

    none = F.array().cast("array<string>")
    docs = probes.where(F.col("role") == "feed").select(
        "site", "probe_idx", F.from_xml(F.col("body"), FEED_SCHEMA, {"mode": "PERMISSIVE"}).alias("x")
    )
    links = F.concat(
        F.coalesce(F.transform(F.col("x.channel.item"), item_link), none),
        F.coalesce(F.transform(F.col("x.item"), item_link), none),
        F.coalesce(F.transform(F.col("x.entry"), entry_link), none),
    )
    x = docs.select("site", "probe_idx", F.posexplode_outer(links).alias("pos", "u"))
    return x.where(F.col("u").isNotNull() & (F.col("u") != "")).select(
        "site", F.lit("feed").alias("source"), F.btrim("u", F.lit(PY_WHITESPACE)).alias("url"),
        F.lit(None).cast("date").alias("lastmod"), F.struct("probe_idx", "pos").alias("src_order"))


# ----------------------------------------------------------------- sections

def _emit(df: DataFrame, arr, source: str, order_field: str = "pos") -> DataFrame:
    """Explode an array of link structs into candidate rows."""
    x = df.select("site", F.posexplode_outer(arr).alias("i", "l")).where("i is not null")
    return x.select("site", F.lit(source).alias("source"), F.col("l.full_url").alias("url"),
                    F.lit(None).cast("date").alias("lastmod"), F.struct("i").alias("src_order"))


def discover_sections(probes: DataFrame) -> DataFrame:
    """Links of each section page (13 paths), resolved, kept if F1."""
    pages = probes.where(F.col("role") == "section").select("site", "domain", "url", "body", "probe_idx")
    pages = with_link_array(pages, "body", "url", "links", with_nav=False)
    keep = F.filter("links", lambda e: U.is_content_url(e["full_url"], F.col("domain")))
    x = pages.select("site", "probe_idx", F.posexplode_outer(keep).alias("i", "l")).where("i is not null")
    return x.select("site", F.lit("section").alias("source"), F.col("l.full_url").alias("url"),
                    F.lit(None).cast("date").alias("lastmod"), F.struct("probe_idx", "i").alias("src_order"))


# ---------------------------------------------------------------------- SPA

def discover_spa(probes: DataFrame) -> DataFrame:
    """P5: href patterns in the raw home HTML (F1 applied), then JSON "href"
    values starting with '/' that name blog/article/post (no F1); ordered
    append-if-absent (T4) = array_distinct of the concatenation."""
    home = probes.where(F.col("role") == "home").select("site", "domain", "base_url", "body")
    arrs = []
    for pat in SPA_HREF_RES:
        m = F.transform(F.regexp_extract_all("body", F.lit(pat), 1), lambda x: U.url_join(F.col("base_url"), x))
        arrs.append(F.filter(m, lambda u: U.is_content_url(u, F.col("domain"))))
    j = F.filter(F.regexp_extract_all("body", F.lit(SPA_JSON_RE), 1),
                 lambda x: x.startswith("/") & F.exists(_lit_array(SPA_JSON_WORDS), lambda k: F.lower(x).contains(k)))
    arrs.append(F.transform(j, lambda x: U.url_join(F.col("base_url"), x)))
    home = home.withColumn("spa", F.array_distinct(F.concat(*arrs)))
    x = home.select("site", F.posexplode_outer("spa").alias("i", "url")).where("i is not null")
    return x.select("site", F.lit("spa").alias("source"), "url", F.lit(None).cast("date").alias("lastmod"),
                    F.struct("i").alias("src_order"))


# --------------------------------------------------------------- navigation

def _first(array, most: int | None):
    return array if most is None else F.slice(array, 1, most)


def discover_navigation(probes: DataFrame, fetches: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Nav links (nav/header/menu first, then all; duplicates count), keyword
    match on text else href (F16), same domain; they (the first few, W7) are
    looked up (J4); their links pass F2, or when none does, the loose links
    (the first few, F17, W8); set semantics at the end (T3)."""
    home = probes.where(F.col("role") == "home").select("site", "domain", "base_url", "body")
    home = with_link_array(home, "body", "base_url", "links", with_nav=True)
    cand = F.filter("links", lambda e: U.is_nav_link(e["text"], e["href"]) & U.is_same_domain(e["full_url"], F.col("domain")))
    secs = home.select("site", "domain", F.posexplode_outer(_first(cand, limits.nav_sections)).alias("sec_no", "l")).where("sec_no is not null")
    sec_pages = lookup(cut_lineage(secs.select("site", "domain", "sec_no", F.col("l.full_url").alias("url"))), fetches)
    sp = with_link_array(sec_pages.select("site", "domain", "sec_no", "url", "body"), "body", "url", "links", with_nav=False)
    strict = F.filter("links", lambda e: U.is_section_content_url(e["full_url"], F.col("url"), F.col("domain")))
    loose = _first(F.filter("links", lambda e: U.is_loose_link(e["href"], e["full_url"], F.col("url"), F.col("domain"))),
                   limits.loose_links)
    sp = sp.withColumn("strict", strict).withColumn("picked", F.when(F.size("strict") > 0, F.col("strict")).otherwise(loose))
    x = sp.select("site", "sec_no", F.posexplode_outer("picked").alias("i", "l")).where("i is not null")
    return x.select("site", F.lit("navigation").alias("source"), F.col("l.full_url").alias("url"),
                    F.lit(None).cast("date").alias("lastmod"), F.struct("sec_no", "i").alias("src_order"))


# ----------------------------------------------------------------- rendered

def api_payload_urls(fetches: DataFrame, sites: DataFrame) -> DataFrame:
    """S6 + C10: JSON API responses of a site -> string values under url/link/href/slug/path.

    A response belongs to the site on whose host, under the same scheme, the
    page lies that asked for it (column ``page_url``); where that is null or
    lacking, to its own host's.
    Values under other keys are searched recursively; a non-string value under
    one of those keys is not descended into. One level of nesting is opened
    at a time, as VARIANT, until no object or array is left.
    """
    keys = ["url", "link", "href", "slug", "path"]
    s = sites.select("site", "base_url", U.url_netloc("base_url").alias("domain"))
    known = "page_url" in fetches.columns
    asked_by = F.coalesce("page_url", "url") if known else F.col("url")
    asking_scheme = U.url_scheme("page_url") if known else F.lit(None).cast("string")
    api = fetches.where(
        (F.col("status") == 200)
        & F.lower(F.coalesce(F.col("content_type"), F.lit(""))).contains("json")
        & (F.exists(_lit_array(API_URL_SUFFIXES), lambda sfx: F.col("url").endswith(sfx)) | F.col("url").contains("api"))
    ).select(U.url_netloc(asked_by).alias("domain"), asking_scheme.alias("scheme"), "url", F.try_parse_json("body").alias("v"))
    same_scheme = F.col("scheme").isNull() | (F.col("scheme") == U.url_scheme("base_url"))
    frontier = api.join(s, "domain").where(same_scheme).select("site", "base_url", "domain", F.col("url").alias("api_url"), "v")
    found = None
    while True:
        frontier = cut_lineage(frontier)
        if found is not None and frontier.isEmpty():
            break
        obj = F.try_variant_get("v", "$", "map<string,variant>")
        arr = F.try_variant_get("v", "$", "array<variant>")
        entries = F.coalesce(
            F.map_entries(obj),
            F.transform(arr, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))),
        )
        kv = frontier.select("site", "base_url", "domain", "api_url", F.explode_outer(entries).alias("kv")).select(
            "site", "base_url", "domain", "api_url", F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))
        hit = kv.where(F.col("key").isin(*keys) & (F.schema_of_variant("value") == "STRING")).select(
            "site", "base_url", "domain", "api_url", F.col("value").cast("string").alias("raw"))
        found = hit if found is None else found.unionByName(hit)
        nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        frontier = kv.where(~F.coalesce(F.col("key").isin(*keys), F.lit(False)) & F.col("value").isNotNull() & nested).select(
            "site", "base_url", "domain", "api_url", F.col("value").alias("v"))
    # resolve and test inside a one-element array: a row filter on the
    # resolved URL would get the whole urljoin expression substituted into it
    ok = F.filter(F.array(U.url_join(F.col("base_url"), F.col("raw"))),
                  lambda u: U.is_same_domain(u, F.col("domain")) & U.is_rendered_content_url(u))
    return found.select("site", F.explode_outer(ok).alias("url")).where("url is not null")


def discover_rendered(probes: DataFrame, fetches: DataFrame, sites: DataFrame) -> DataFrame:
    """P2 (T5): links and data-attribute URLs of the rendered home page plus API payload URLs."""
    home = probes.where((F.col("role") == "home") & F.col("rendered_html").isNotNull() & F.col("render_error").isNull())
    home = with_link_array(home.select("site", "domain", "base_url", "rendered_html"), "rendered_html", "base_url",
                           "links", with_nav=False)
    keep = F.filter("links", lambda e: U.is_same_domain(e["full_url"], F.col("domain")) & U.is_rendered_content_url(e["full_url"]))
    a = home.select("site", F.explode_outer(keep).alias("l")).where("l is not null").select("site", F.col("l.full_url").alias("url"))
    d = data_attribute_urls(home.select("site", "domain", "base_url", "rendered_html"), "rendered_html",
                            ["site", "domain", "base_url"])
    ok = F.filter(F.array(U.url_join(F.col("base_url"), F.col("value"))),
                  lambda u: U.is_same_domain(u, F.col("domain")) & U.is_rendered_content_url(u))
    b = d.select("site", F.explode_outer(ok).alias("url")).where("url is not null")
    return a.unionByName(b).unionByName(api_payload_urls(fetches, sites)).distinct().select(
        "site", F.lit("rendered").alias("source"), "url", F.lit(None).cast("date").alias("lastmod"),
        F.struct(F.lit(0).alias("k")).alias("src_order"))


# ------------------------------------------------------ waterfall and union

def _distinct_count(df: DataFrame, name: str) -> DataFrame:
    return df.select("site", "url").distinct().groupBy("site").agg(F.count(F.lit(1)).alias(name))


def discover(sites: DataFrame, fetches: DataFrame, limits: Limits = ALL) -> DataFrame:
    """All sources with the <5 waterfall (W9), union-distinct (T1), ordered.
    All rows by default; ``SINGLE_SITE`` holds the one-site profile's limits.

    Output: site, url, source, lastmod, ord (1-based per site).
    """
    return rank_candidates(source_candidates(sites, fetches, limits))


def source_candidates(sites: DataFrame, fetches: DataFrame, limits: Limits = ALL) -> DataFrame:
    """What every source of the waterfall gives, before the union-distinct (A4):
    site, url, source, lastmod."""
    # the probe pages feed five branches: materialize them once (reliable
    # checkpoint in the shared folder) instead of re-reading the archive
    probes = cut_lineage(lookup(probe_table(sites), fetches))
    base = discover_sitemaps(probes, fetches, limits).select("site", "url", "source", "lastmod") \
        .unionByName(discover_feeds(probes).select("site", "url", "source", "lastmod")) \
        .unionByName(discover_sections(probes).select("site", "url", "source", "lastmod"))
    # candidate tables are narrow and each feeds a gate and the union: materialize
    base = cut_lineage(base)
    s = sites.select("site", "use_browser")
    n0 = s.join(_distinct_count(base, "n0"), "site", "left").fillna(0, ["n0"])
    spa_sites = n0.where(F.col("n0") < WATERFALL_MIN).select("site")
    spa = discover_spa(probes.join(spa_sites, "site", "left_semi")).select("site", "url", "source", "lastmod")
    acc1 = cut_lineage(base.unionByName(spa))
    n1 = s.join(_distinct_count(acc1, "n1"), "site", "left").fillna(0, ["n1"])
    nav_sites = n1.where(F.col("n1") < WATERFALL_MIN).select("site")
    nav = discover_navigation(probes.join(nav_sites, "site", "left_semi"), fetches, limits)
    nav = nav.select("site", "url", "source", "lastmod").distinct()  # T3
    acc2 = cut_lineage(acc1.unionByName(nav))
    n2 = s.join(_distinct_count(acc2, "n2"), "site", "left").fillna(0, ["n2"])
    r_sites = n2.where((F.col("n2") < WATERFALL_MIN) & F.col("use_browser")).select("site")
    rendered = discover_rendered(probes.join(r_sites, "site", "left_semi"), fetches,
                                 sites.join(r_sites, "site", "left_semi")).select("site", "url", "source", "lastmod")
    return acc2.unionByName(rendered)


def rank_candidates(cands: DataFrame) -> DataFrame:
    """T1 + the documented order: one row per (site, url) with its best source;
    ord numbers a site's URLs by (source priority, lastmod desc nulls last, url).
    No task holds a whole site."""
    prio = F.create_map(*[x for k, v in SOURCE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    newest_first = F.coalesce(-F.datediff("lastmod", F.lit("1970-01-01")), F.lit(1 << 30))
    c = cands.withColumn("prio", prio[F.col("source")])
    best = c.groupBy("site", "url").agg(
        F.min_by(F.struct("prio", "source", "lastmod"), F.struct("prio", newest_first)).alias("b")
    )
    best = best.select("site", "url", F.col("b.prio").alias("prio"), F.col("b.source").alias("source"),
                       F.col("b.lastmod").alias("lastmod"))
    order = [F.col("prio"), F.col("lastmod").desc_nulls_last(), F.col("url")]
    return number_within(best, "site", order, "ord").drop("prio")
