"""URL column functions: parsing, joining and the content-URL predicates.

All functions map Columns to Columns and stay in the JVM: regex and string
functions, and array higher-order functions, which run interpreted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, contains_any
from .tree import let

# RFC 3986 appendix-B split, with the scheme restricted to the characters a
# scheme may hold (otherwise the text before ':' is path, as in urlparse).
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# The ``;params`` of a path's last segment.
PARAMS_RE = r";([^/]*)$"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
# ---------------------------------------------------------------------------

# Schemes for which relative references are resolved.
USES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
]

# General content-URL test (discovery): rejected path substrings.
CONTENT_SKIP = [
    "/tag/", "/category/", "/author/", "/page/",
    "/search", "/login", "/register", "/contact", "/about",
    "/privacy", "/terms", "/legal/", "/schedule", "/demo",
    "/signup", "/download", "/pricing", "/support",
    ".pdf", ".jpg", ".png", ".gif", ".css", ".js",
    ".xml", ".txt", ".ico", ".woff", ".woff2", ".ttf", ".eot",
    "/_next/", "/static/", "/assets/",
]
# General content-URL test: accepted path substrings, then date patterns.
CONTENT_ACCEPT = [
    "/blog/", "/blogs/", "/post/", "/posts/", "/article/", "/articles/",
    "/news/", "/casestudies/", "/case-studies/", "/story/", "/stories/",
    "/resources/", "/resource/", "/insights/", "/whitepapers/", "/guides/",
    "/updates/", "/content/", "/press/", "/media/",
]
CONTENT_ACCEPT_RE = [r"/\p{Nd}{4}/", r"/\p{Nd}{4}/\p{Nd}{2}/"]
# General content-URL test: corporate path words rejected for deep paths.
CORPORATE_SKIP = [
    "solutions/", "products/", "services/", "industries/",
    "company/", "careers/", "investors/", "partners/",
]

# Section content-URL test: rejected path substrings.
SECTION_SKIP = [
    "/tag/", "/category/", "/author/", "/page/",
    "/search", "/login", "/register", "/contact", "/about",
    "/privacy", "/terms", "/legal/", "/schedule", "/demo",
    "/signup", "/download", "/pricing", "/support",
    ".pdf", ".jpg", ".png", ".gif", ".css", ".js",
    ".xml", ".txt", ".ico", "/api/", "/_next/",
]
# Section content-URL test: accepted patterns (date regexes, then substrings).
SECTION_ACCEPT_RE = [r"/\p{Nd}{4}/", r"/\p{Nd}{4}/\p{Nd}{2}/"]
SECTION_ACCEPT = [
    "/post/", "/posts/", "/article/", "/articles/",
    "/story/", "/stories/", "/entry/", "/entries/",
    "/how-", "/what-", "/why-", "/guide-", "/tutorial-",
    "/resource/", "/resources/", "/insights/", "/updates/",
    "/content/", "/press/", "/media/", "/news/",
]

# Rendered-page content-URL test: rejected path substrings.
RENDERED_SKIP = [
    "/tag/", "/category/", "/author/", "/page/",
    "/search", "/login", "/register", "/contact",
    ".pdf", ".jpg", ".png", ".gif", ".css", ".js",
    "/api/", "/admin/", "/comments", "/share",
    "/subscribe", "/unsubscribe", "/archive",
    "/about", "/privacy", "/terms",
]
RENDERED_ACCEPT = [
    "/blog/", "/post/", "/article/", "/news/",
    "/guide/", "/tutorial/", "/story/", "/p/",
]

# Likely-blog URL indicators (template exclusion).
BLOG_URL_INDICATORS = [
    "/blog/", "/blogs/", "/article/", "/articles/", "/post/", "/posts/",
    "/news/", "/resource/", "/resources/", "/insights/", "/updates/",
    "/content/", "/press/", "/media/", "/stories/",
]

# Paths that make a base URL a blog section (routing).
SECTION_ROUTE_PATHS = ["/blog", "/blogs", "/articles", "/posts", "/news", "/resource", "/resources"]

# Navigation keywords (link text, else href).
NAV_KEYWORDS = [
    "blog", "blogs", "articles", "posts", "news", "resources", "resource",
    "insights", "stories", "updates", "content", "press", "media",
    "guides", "whitepapers", "case studies", "learn", "knowledge",
]

# Probe paths joined to a site's base URL.
SITEMAP_PROBES = ["/sitemap.xml", "/sitemap_index.xml", "/robots.txt"]
FEED_PROBES = ["/feed", "/rss", "/feed.xml", "/rss.xml", "/atom.xml", "/blog/feed", "/blog/rss"]
SECTION_PROBES = [
    "/blog", "/blogs", "/articles", "/posts", "/news", "/resource", "/resources",
    "/insights", "/updates", "/content", "/press", "/media", "/stories",
]


# ---------------------------------------------------------------------------
# Parsing
# ---------------------------------------------------------------------------

def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(col_(url), URL_RE, 1))


def url_netloc(url) -> Column:
    """Network location exactly as written (case, port and userinfo kept)."""
    return F.regexp_extract(col_(url), URL_RE, 2)


def url_has_netloc(url) -> Column:
    return col_(url).rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")


def url_path(url) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(col_(url), URL_RE, 3), PARAMS_RE, "")


def url_params(url) -> Column:
    return F.regexp_extract(F.regexp_extract(col_(url), URL_RE, 3), PARAMS_RE, 1)


def url_query(url) -> Column:
    return F.regexp_extract(col_(url), URL_RE, 4)


def url_fragment(url) -> Column:
    return F.regexp_extract(col_(url), URL_RE, 5)


def path_depth(path) -> Column:
    """``path.count('/')``."""
    p = col_(path)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def path_parts(path) -> Column:
    """``[p for p in path.split('/') if p]``."""
    return F.filter(F.split(col_(path), "/"), lambda x: x != "")


def default_scheme(url) -> Column:
    """Prefix ``https://`` unless the URL starts with http:// or https://."""
    u = col_(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def _unparse(scheme, netloc, path, params, query, fragment) -> Column:
    p = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
        p,
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _remove_dot_segments(segments: Column) -> Column:
    dots = F.array_contains(segments, ".") | F.array_contains(segments, "..")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.try_element_at(segments, F.lit(-1))
    folded = F.concat(folded, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    joined = F.array_join(F.when(dots, folded).otherwise(segments), "/")
    return let(joined, lambda j: F.when(j == "", F.lit("/")).otherwise(j))


def _split(url: Column) -> Column:
    """The five parts of a URL, its params apart from its path, each matched once."""
    full = F.regexp_extract(url, URL_RE, 3)
    return let(
        F.struct(url.alias("url"), url_scheme(url).alias("scheme"), url_netloc(url).alias("netloc"), full.alias("full"),
                 url_query(url).alias("query"), url_fragment(url).alias("fragment")),
        lambda u: F.struct(u["url"].alias("url"), u["scheme"].alias("scheme"), u["netloc"].alias("netloc"),
                           F.regexp_replace(u["full"], PARAMS_RE, "").alias("path"),
                           F.regexp_extract(u["full"], PARAMS_RE, 1).alias("params"),
                           u["query"].alias("query"), u["fragment"].alias("fragment")),
    )


def url_join(base, href) -> Column:
    """Resolve ``href`` against ``base`` the way ``urllib.parse.urljoin`` does.

    Every value that is used more than once is bound by ``let``: written out
    at each use, the patterns would run some hundred times a row."""
    parts = F.struct(_split(col_(base)).alias("b"), _split(col_(href)).alias("h"))
    return let(parts, lambda x: _joined(x["b"], x["h"]))


def _joined(b: Column, h: Column) -> Column:
    bs, bn, bp = b["scheme"], b["netloc"], b["path"]
    hn, hp, hpar, hq, hf = h["netloc"], h["path"], h["params"], h["query"], h["fragment"]

    def merged():
        def cleaned(rel):
            n = F.size(rel)
            return F.filter(rel, lambda x, i: (i == 0) | (i == n - 1) | (x != ""))

        base_dir = let(F.split(bp, "/"), lambda s: F.when(F.try_element_at(s, F.lit(-1)) != "", F.slice(s, 1, F.size(s) - 1)).otherwise(s))
        return let(F.concat(base_dir, F.split(hp, "/")), cleaned)

    segments = F.when(hp.startswith("/"), F.split(hp, "/")).otherwise(merged())

    def resolved(hs):
        return (
            F.when(b["url"].isNull() | (b["url"] == ""), h["url"])
            .when(h["url"] == "", b["url"])
            .when((hs != bs) | ~hs.isin(*USES_RELATIVE), h["url"])
            .when(hn != "", _unparse(hs, hn, hp, hpar, hq, hf))
            .when((hp == "") & (hpar == ""), _unparse(hs, bn, bp, b["params"], F.when(hq != "", hq).otherwise(b["query"]), hf))
            .otherwise(let(let(segments, _remove_dot_segments), lambda path: _unparse(hs, bn, path, hpar, hq, hf)))
        )

    return let(F.when(h["scheme"] == "", bs).otherwise(h["scheme"]), resolved)


# ---------------------------------------------------------------------------
# Predicates
# ---------------------------------------------------------------------------

def _any_re(c: Column, patterns) -> Column:
    return c.rlike("|".join(patterns))


def is_content_url(url, domain) -> Column:
    """General content-URL test used by sitemap, section and SPA discovery."""
    path = F.lower(url_path(url))
    deep_ok = (F.length(path) > 1) & (path != "/") & (path_depth(path) >= 2) & ~contains_any(path, CORPORATE_SKIP)
    return (
        F.when(url_netloc(url) != col_(domain), F.lit(False))
        .when(contains_any(path, CONTENT_SKIP), F.lit(False))
        .when(contains_any(path, CONTENT_ACCEPT) | _any_re(path, CONTENT_ACCEPT_RE), F.lit(True))
        .otherwise(deep_ok)
    )


def is_section_content_url(url, section_url, domain) -> Column:
    """Content-URL test for links found on a section page."""
    path = F.lower(url_path(url))
    spath = F.lower(url_path(section_url))
    deeper = (
        path.startswith(spath)
        & (path != spath)
        & (F.size(path_parts(path)) > F.size(path_parts(spath)))
    )
    return (
        F.when(url_netloc(url) != col_(domain), F.lit(False))
        .when(contains_any(path, SECTION_SKIP), F.lit(False))
        .when(deeper, F.lit(True))
        .otherwise(_any_re(path, SECTION_ACCEPT_RE) | contains_any(path, SECTION_ACCEPT))
    )


def is_rendered_content_url(url) -> Column:
    """Content-URL test applied to links of a rendered page (no domain test)."""
    u = col_(url)
    path = F.lower(url_path(u))
    full = F.lower(u)
    sub = full.contains("substack.com")
    return (
        F.when(contains_any(path, RENDERED_SKIP), F.lit(False))
        .when(sub & (path.contains("/comments") | path.contains("/t/")), F.lit(False))
        .when(sub & path.contains("/p/") & ~path.endswith("/comments"), F.lit(True))
        .when(contains_any(path, RENDERED_ACCEPT), F.lit(True))
        .otherwise((F.length(path) > 1) & (path != "/") & (path_depth(path) >= 2))
    )


def is_same_domain(url, domain) -> Column:
    return url_netloc(url) == col_(domain)


def is_likely_blog_url(url) -> Column:
    return contains_any(F.lower(col_(url)), BLOG_URL_INDICATORS)


def route(base_url) -> Column:
    """'direct' for a specific page, 'section' for a blog section, else 'site'."""
    p = url_path(base_url)
    trimmed = F.lower(F.regexp_replace(p, "/+$", ""))
    is_section = trimmed.isin(*SECTION_ROUTE_PATHS)
    direct = (p != "") & (p != "/") & ~p.endswith("/") & ~is_section
    return F.when(direct, F.lit("direct")).when(is_section, F.lit("section")).otherwise(F.lit("site"))


def is_nav_link(text, href) -> Column:
    """Link text holds a navigation keyword, else its href does."""
    t = F.lower(col_(text))
    h = F.lower(col_(href))
    return contains_any(t, NAV_KEYWORDS) | contains_any(h, NAV_KEYWORDS)


def is_loose_link(href, full_url, section_url, domain) -> Column:
    h = col_(href)
    return (
        h.isNotNull()
        & (h != "")
        & ~h.startswith("#")
        & ~h.startswith("javascript:")
        & is_same_domain(full_url, domain)
        & (col_(full_url) != col_(section_url))
    )
