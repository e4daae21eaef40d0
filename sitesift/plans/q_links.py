"""Catalog: link table and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import url_netloc
from ..operators import discover as D
from ..operators.links import NAV_SPAN_RE, page_links
from ..sources.archive import read_table
from ..sources.crawl import KINDS, LARGE, site_archive
from ..session import cut_lineage
from . import sqlparts as S
from .catalog import register

LINKS_SQL = f"""
WITH c AS (SELECT page_id, url, {S.remove_noise('html')} AS clean FROM pages),
n AS (SELECT page_id, url, clean, array_to_string(regexp_extract_all(clean, {S.q(NAV_SPAN_RE)}, 0), ' ') AS nav FROM c),
arr AS (
  SELECT page_id, url,
         list_concat({S.anchors('nav', 'true')}, {S.anchors('clean')}) AS l
  FROM n
),
x AS (SELECT page_id, url, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM arr),
y AS (
  SELECT page_id, url, pos, e.from_nav AS from_nav,
         {S.href('e.a')} AS href,
         {S.strip(S.text_of('e.body'))} AS text
  FROM x
)
SELECT page_id, {S.url_netloc('url')} AS site, pos, from_nav, href, text, {S.url_join('url', 'href')} AS full_url FROM y
"""


@register("h1_links", LINKS_SQL)
def h1_links(spark, sf_dir):
    """H1 + T2 + U2: anchors of every page (nav/header/menu copies first), resolved."""
    p = read_table(spark, sf_dir, "pages")
    lk = page_links(p, "html", "url", ["page_id"], with_nav=True)
    return lk.select("page_id", url_netloc("page_url").alias("site"), "pos", "from_nav", "href", "text", "full_url")


# Anchors in all quotings, unclosed ones, and character references of all kinds, after each page's own.
_QUOTING = ("<a href='/one?a=1&amp;b=&#x32;'>caf&eacute; &#8217;1&rsquo;</a><a class=x href=/two/&#116;wo>&unknown; &amp;lt; &#0;"
            "<A data-href='no' HREF = \"/three\">3</A > out <a name=x>no link</a><a href=/four>never closed &copy &copy;")


@register("h1_link_quoting", LINKS_SQL.replace("FROM pages)", f"FROM (SELECT page_id, url, html || {S.q(_QUOTING)} AS html FROM pages))", 1))
def h1_link_quoting(spark, sf_dir):
    """H1 + H5: the same over pages with links in single, double and no quotes."""
    p = read_table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit(_QUOTING)))
    lk = page_links(p, "html", "url", ["page_id"], with_nav=True)
    return lk.select("page_id", url_netloc("page_url").alias("site"), "pos", "from_nav", "href", "text", "full_url")


#: URLs per sitemap file in these queries: small, so that sites have several.
PER_FILE = 10


def crawl(spark, sf_dir):
    return site_archive(read_table(spark, sf_dir, "pages"), per_file=PER_FILE)


# What every source must give, straight from the page table: no document is
# built or read, a site's kind alone says where its URLs turn up.
_KIND_LIST = "[" + ", ".join(S.q(k) for k in KINDS) + "]"
CANDIDATES_SQL = f"""
u AS (
  SELECT DISTINCT url, {S.url_netloc('url')} AS domain, {S.url_scheme('url')} || '://' || {S.url_netloc('url')} || '/' AS site,
         ('0x' || substr(md5(url), 1, 8))::BIGINT AS x
  FROM pages WHERE {S.url_netloc('url')} <> '' AND {S.url_scheme('url')} <> ''),
s AS (
  SELECT site, min(domain) AS domain, count(*) AS n, ('0x' || substr(md5(site), 1, 6))::BIGINT AS h FROM u GROUP BY site),
k AS (SELECT site, domain, {_KIND_LIST}[CASE WHEN n > {LARGE} THEN h % 2 ELSE h % {len(KINDS)} END + 1] AS kind FROM s),
w AS (SELECT u.*, k.kind, CASE WHEN x % 5 <> 0 THEN DATE '2024-01-01' + (x % 90)::INTEGER END AS day FROM u JOIN k USING (site)),
base AS (
  SELECT site, url, 'sitemap' AS source, day AS lastmod FROM w
  WHERE (kind IN ('sitemap', 'robots') OR (kind = 'atom_and_sitemap' AND x % 2 = 0)) AND {S.is_content_url('url', 'domain')}
  UNION ALL SELECT site, url, 'feed', NULL FROM w WHERE kind IN ('feed', 'atom_and_sitemap')
  UNION ALL SELECT site, url, 'section', NULL FROM w WHERE kind = 'section' AND {S.is_content_url('url', 'domain')}),
n0 AS (SELECT k.*, (SELECT count(DISTINCT url) FROM base WHERE base.site = k.site) AS n FROM k),
spa AS (
  SELECT w.site, w.url, 'spa' AS source, NULL::DATE AS lastmod FROM w JOIN n0 USING (site)
  WHERE n < 5 AND w.kind IN ('feed', 'home') AND {S.is_content_url('w.url', 'w.domain')}
  UNION ALL SELECT site, site || 'articles/all-of-them', 'spa', NULL FROM n0 WHERE n < 5 AND kind IN ('feed', 'home')),
acc1 AS (SELECT * FROM base UNION ALL SELECT * FROM spa),
n1 AS (SELECT k.*, (SELECT count(DISTINCT url) FROM acc1 WHERE acc1.site = k.site) AS n FROM k),
section_links AS (
  SELECT w.site, w.url, {S.is_section_content_url('w.url', "w.site || 'all-pages'", 'w.domain')} AS strict
  FROM w JOIN n1 USING (site) WHERE n < 5 AND w.kind = 'navigation'),
nav AS (
  SELECT site, url, 'navigation' AS source, NULL::DATE AS lastmod FROM section_links l
  WHERE strict OR NOT EXISTS (SELECT 1 FROM section_links o WHERE o.site = l.site AND o.strict)),
acc2 AS (SELECT * FROM acc1 UNION ALL SELECT * FROM nav),
n2 AS (SELECT k.*, (SELECT count(DISTINCT url) FROM acc2 WHERE acc2.site = k.site) AS n FROM k),
found AS (
  SELECT * FROM acc2
  UNION ALL SELECT w.site, w.url, 'rendered', NULL FROM w JOIN n2 USING (site)
  WHERE n < 5 AND w.kind = 'rendered' AND {S.is_rendered_content_url('w.url')}),
best AS (
  SELECT *, list_position(['direct', 'sitemap', 'feed', 'section', 'spa', 'navigation', 'rendered'], source) AS prio FROM found
  QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY prio, lastmod DESC NULLS LAST) = 1),
ranked AS (
  SELECT site, url, source, lastmod, row_number() OVER (PARTITION BY site ORDER BY prio, lastmod DESC NULLS LAST, url) AS ord FROM best)"""


@register("p1_discover", f"WITH {CANDIDATES_SQL.strip()}\nSELECT site, url, source, lastmod::VARCHAR AS lastmod, ord FROM ranked")
def p1_discover(spark, sf_dir):
    """Sitemaps, feeds, sections, then SPA / navigation / rendered by the <5 waterfall, over all pages; ranked."""
    sites, fetches = crawl(spark, sf_dir)
    return D.discover(sites, fetches).withColumn("lastmod", F.col("lastmod").cast("string"))


@register(
    "p1_source_counts",
    f"""WITH {CANDIDATES_SQL.strip()}
SELECT site, source, count(*) AS n_urls, (SELECT count(DISTINCT url) FROM found o WHERE o.site = found.site) AS n_distinct
FROM found GROUP BY site, source""",
)
def p1_source_counts(spark, sf_dir):
    """A4: URLs that each source gives, before the union-distinct; A3: distinct URLs per site."""
    sites, fetches = crawl(spark, sf_dir)
    c = cut_lineage(D.source_candidates(sites, fetches))
    total = c.select("site", "url").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("n_distinct"))
    return c.groupBy("site", "source").agg(F.count(F.lit(1)).alias("n_urls")).join(total, "site")


# ------------------------------------------- single-page discovery steps
# Each page is taken as the fetched home / section page of its own host, with
# a quarter of its links rewritten to blog and dated paths.

def _variant(html, pid):
    """Rewrite root-relative hrefs on half of the pages so that links look
    like blog posts or dated posts (otherwise every link is /word)."""
    return (
        F.when(pid % 4 == 0, F.replace(html, F.lit('href="/'), F.lit('href="/blog/')))
        .when(pid % 4 == 1, F.replace(html, F.lit('href="/'), F.lit('href="/2024/05/')))
        .otherwise(html)
    )


def _as_probe_pages(spark, sf_dir):
    from ..functions.urls import url_scheme

    p = read_table(spark, sf_dir, "pages")
    return p.select(
        "page_id", url_netloc("url").alias("site"), url_netloc("url").alias("domain"),
        F.concat(url_scheme("url"), F.lit("://"), url_netloc("url"), F.lit("/")).alias("base_url"),
        F.col("url"), _variant(F.col("html"), F.col("page_id")).alias("body"),
        F.lit("home").alias("role"), F.col("page_id").alias("probe_idx"))


_VARIANT_SQL = """
SELECT page_id, url, {netloc} AS site, {netloc} AS domain, {scheme} || '://' || {netloc} || '/' AS base_url,
  CASE WHEN page_id % 4 = 0 THEN replace(html, 'href="/', 'href="/blog/')
       WHEN page_id % 4 = 1 THEN replace(html, 'href="/', 'href="/2024/05/') ELSE html END AS body
FROM pages
""".format(netloc=S.url_netloc("url"), scheme=S.url_scheme("url"))

_LINKS_OF = """
x AS (SELECT page_id, site, domain, base_url, url, unnest(l).a AS a, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT *, {anchors} AS l FROM (SELECT *, {clean} AS clean FROM v))),
y AS (SELECT page_id, site, domain, base_url, url, pos, {href} AS href FROM x),
z AS (SELECT *, {full} AS full_url FROM y)
""".format(clean=S.remove_noise("body"), anchors=S.anchors("clean"), href=S.href("a"),
           full=S.url_join("url", "href"))


@register(
    "p4_section_links",
    f"""WITH v AS ({_VARIANT_SQL}), {_LINKS_OF.strip()}
SELECT page_id, pos, full_url AS url FROM z WHERE {S.is_content_url('full_url', 'domain')}""",
)
def p4_section_links(spark, sf_dir):
    """P4 step (H1 + U2 + F1): links of a section page kept when they look like content."""
    pg = _as_probe_pages(spark, sf_dir).withColumn("role", F.lit("section"))
    out = D.discover_sections(pg)
    return out.select(F.col("src_order.probe_idx").cast("long").alias("page_id"),
                      F.col("src_order.i").alias("pos"), "url")


_SPA_SQL = f"""
WITH v AS ({_VARIANT_SQL}),
m AS (
  SELECT page_id, 0 AS pat, unnest(l) AS raw, generate_subscripts(l, 1) AS pos, base_url, domain
  FROM (SELECT *, regexp_extract_all(body, {S.q(D.SPA_HREF_RES[0])}, 1) AS l FROM v)
  UNION ALL
  SELECT page_id, 1, unnest(l), generate_subscripts(l, 1), base_url, domain
  FROM (SELECT *, regexp_extract_all(body, {S.q(D.SPA_HREF_RES[1])}, 1) AS l FROM v)
  UNION ALL
  SELECT page_id, 2, unnest(l), generate_subscripts(l, 1), base_url, domain
  FROM (SELECT *, regexp_extract_all(body, {S.q(D.SPA_JSON_RE)}, 1) AS l FROM v)
),
r AS (SELECT *, {S.url_join('base_url', 'raw')} AS u FROM m),
k AS (
  SELECT * FROM r WHERE (pat < 2 AND {S.is_content_url('u', 'domain')})
     OR (pat = 2 AND starts_with(raw, '/') AND {S.any_('lower(raw)', D.SPA_JSON_WORDS)})
)
SELECT page_id, u AS url, (row_number() OVER (PARTITION BY page_id ORDER BY pat, pos) - 1)::INTEGER AS i
FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, u ORDER BY pat, pos) = 1)
"""


@register("p5_spa_urls", _SPA_SQL)
def p5_spa_urls(spark, sf_dir):
    """P5 + T4: href patterns (F1) then JSON hrefs, ordered append-if-absent, per page."""
    pg = _as_probe_pages(spark, sf_dir)
    out = D.discover_spa(pg.withColumn("site", F.col("page_id").cast("string")))
    return out.select(F.col("site").cast("long").alias("page_id"), "url", F.col("src_order.i").alias("i"))


_NAV_SQL = f"""
WITH v AS ({_VARIANT_SQL}),
c AS (SELECT page_id, site, domain, base_url, url, {S.remove_noise('body')} AS clean FROM v),
n AS (SELECT *, array_to_string(regexp_extract_all(clean, {S.q(NAV_SPAN_RE)}, 0), ' ') AS nav FROM c),
arr AS (
  SELECT page_id, domain, base_url,
         list_concat({S.anchors('nav', 'true')}, {S.anchors('clean')}) AS l
  FROM n
),
x AS (SELECT page_id, domain, base_url, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM arr),
y AS (SELECT page_id, domain, base_url, pos, {S.href('e.a')} AS href,
             {S.strip(S.text_of('e.body'))} AS text FROM x),
z AS (SELECT *, {S.url_join('base_url', 'href')} AS full_url FROM y),
k AS (SELECT * FROM z WHERE {S.is_nav_link('text', 'href')} AND {S.url_netloc('full_url')} = domain)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS sec_no, full_url AS section_url
FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3
"""


@register("p3_nav_sections", _NAV_SQL)
def p3_nav_sections(spark, sf_dir):
    """P3 steps T2 + F16 + W7: nav/header/menu links first, keyword match, same domain, first 3."""
    from ..operators.links import with_link_array
    from ..functions import urls as U

    home = _as_probe_pages(spark, sf_dir).select("page_id", "domain", "base_url", "body")
    home = with_link_array(home, "body", "base_url", "links", with_nav=True)
    cand = F.filter("links", lambda e: U.is_nav_link(e["text"], e["href"]) & U.is_same_domain(e["full_url"], F.col("domain")))
    x = home.select("page_id", F.posexplode_outer(F.slice(cand, 1, D.SINGLE_SITE.nav_sections)).alias("sec_no", "l")).where("sec_no is not null")
    return x.select("page_id", "sec_no", F.col("l.full_url").alias("section_url"))
