"""Catalog: extraction, HTML jobs, gates and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as CL
from ..functions import html as H
from ..functions import quality as Q
from ..functions import tree as T
from ..functions.text import py_strip
from ..operators.dedup import deduplicate
from ..session import cut_lineage
from ..operators.extract import extract, items_of
from ..sources.archive import derived_fetches, pages_as_fetches, read_table, titled_items
from . import sqlparts as S
from . import sqlplans as P
from .catalog import register

# ----------------------------------------------------------------- flagship

FLAGSHIP_SQL = f"""
WITH RECURSIVE {P.extracted(P.fetches_plain(), use_browser=False).strip()},
{P.dedup('items').strip()}
SELECT site, content_type, count(*)::BIGINT AS n_items FROM deduped GROUP BY site, content_type
"""


@register("extract_class_counts", FLAGSHIP_SQL)
def extract_class_counts(spark, sf_dir):
    """Pages -> items (title, markdown, class) -> dedup -> items per site and class."""
    fetches = pages_as_fetches(read_table(spark, sf_dir, "pages"))
    items = items_of(extract(fetches, use_browser=False), keys=("site", "page_id")).withColumnRenamed("page_id", "ord")
    # extraction is the costly map stage; dedup reads its output twice
    items = cut_lineage(items)
    return deduplicate(items).groupBy("site", "content_type").agg(F.count(F.lit(1)).alias("n_items"))


# ------------------------------------------------------ P6 full extraction

P6_SQL = f"""
WITH RECURSIVE {P.extracted(P.fetches_derived(), use_browser=True).strip()}
SELECT site, page_id, status, gate, source, title, content,
       CASE WHEN source IS NOT NULL THEN {S.classify('url', 'title', 'content')} END AS content_type
FROM ex
"""


@register("p6_extract", P6_SQL)
def p6_extract(spark, sf_dir):
    """Every fetch with its gate, the copy that produced the item, and the item."""
    ex = extract(derived_fetches(read_table(spark, sf_dir, "pages")), use_browser=True)
    return ex.select(
        "site", "page_id", "status", "gate", "source",
        F.col("item.title").alias("title"), F.col("item.content").alias("content"),
        F.col("item.content_type").alias("content_type"),
    )


P6_PLAIN_SQL = f"""
WITH RECURSIVE {P.extracted(P.fetches_derived(), use_browser=False).strip()}
SELECT site, page_id, gate, source, md5(content) AS content_md5 FROM ex
"""


@register("p6_extract_no_browser", P6_PLAIN_SQL)
def p6_extract_no_browser(spark, sf_dir):
    """Same archive with the rendered copy disabled (plain mode)."""
    ex = extract(derived_fetches(read_table(spark, sf_dir, "pages")), use_browser=False)
    return ex.select("site", "page_id", "gate", "source", F.md5("item.content").alias("content_md5"))


# ------------------------------------------------------------------- gates

GATES_SQL = f"""
WITH f AS ({P.fetches_derived()})
SELECT page_id, status, strlen(body)::BIGINT AS body_bytes,
       {S.any_('lower(body)', Q.SPA_MARKERS)} AS is_spa,
       {S.is_error_page('body')} AS is_error_page,
       {S.is_valid_html('body')} AS is_valid_html,
       {S.fetch_gate('status', 'strlen(body)', 'body')} AS gate
FROM f
"""


@register("f7_f12_fetch_gates", GATES_SQL)
def fetch_gates(spark, sf_dir):
    """Status gate, size gate, valid HTML, SPA flag, error page."""
    f = derived_fetches(read_table(spark, sf_dir, "pages"))
    f = Q.with_error_page(f, "body", "is_error_page")
    f = Q.with_fetch_gate(f, "status", "body", "gate")
    return f.select(
        "page_id", "status",
        F.octet_length("body").cast("long").alias("body_bytes"),
        Q.is_spa("body").alias("is_spa"),
        "is_error_page",
        Q.is_valid_html("body").alias("is_valid_html"),
        "gate",
    )


# ---------------------------------------------------------------- html jobs

def _variant_html_spark(pages):
    """Pages whose <article> becomes a selector div or nested sections."""
    pid = F.col("page_id")
    h = F.col("html")
    v1 = F.replace(F.replace(h, F.lit("<article>"), F.lit('<div class="post-content">')), F.lit("</article>"), F.lit("</div>"))
    v2 = F.replace(
        F.replace(h, F.lit("<article>"), F.lit("<section><div>x</div>")), F.lit("</article>"), F.lit("</section>")
    )
    v3 = F.replace(F.replace(h, F.lit("<article>"), F.lit("<main>")), F.lit("</article>"), F.lit("</main>"))
    return pages.select(
        "page_id",
        F.when(pid % 4 == 1, v1).when(pid % 4 == 2, v2).when(pid % 4 == 3, v3).otherwise(h).alias("html"),
    )


VARIANT_SQL = """
SELECT page_id, CASE
  WHEN page_id % 4 = 1 THEN replace(replace(html, '<article>', '<div class="post-content">'), '</article>', '</div>')
  WHEN page_id % 4 = 2 THEN replace(replace(html, '<article>', '<section><div>x</div>'), '</article>', '</section>')
  WHEN page_id % 4 = 3 THEN replace(replace(html, '<article>', '<main>'), '</article>', '</main>')
  ELSE html END AS html
FROM pages
"""

HTML_JOBS_SQL = f"""
WITH RECURSIVE v AS (SELECT page_id AS k, html FROM ({VARIANT_SQL})),
{P.tree('v').strip()}
SELECT k AS page_id, title, length(main_html)::BIGINT AS main_len, length(block_html)::BIGINT AS block_len,
       main_md AS main_markdown, md5(block_md) AS block_markdown_md5, length(stripped)::BIGINT AS stripped_len
FROM page
"""


def _html_jobs(pages):
    """page_id and what the tree gives of a page's html."""
    t = "t_"
    df = H.with_content(pages.select("page_id", "html"), "html", t)
    df = T.with_markdown(T.with_markdown(df, t, t + "main", "main_markdown"), t, t + "block", "block_markdown")
    main, block = F.col(t + "main"), F.col(t + "block")
    return df.select(
        "page_id", H.page_title(t).alias("title"),
        F.when(main.isNotNull(), F.length(T.inner_html(t, main))).cast("long").alias("main_len"),
        F.when(block.isNotNull(), F.length(T.inner_html(t, block))).cast("long").alias("block_len"),
        "main_markdown", F.md5("block_markdown").alias("block_markdown_md5"),
        F.length(T.inner_html(t, F.lit(-1))).cast("long").alias("stripped_len"),
    )


@register("h2_h6_html_jobs", HTML_JOBS_SQL)
def html_jobs(spark, sf_dir):
    """H2 title, H3 chrome removal, H4 main content (semantic + largest block), H6 markdown."""
    return _html_jobs(_variant_html_spark(read_table(spark, sf_dir, "pages")))


# Main elements that hold elements of their own name, other tags and quotes, and no end: (start, end) for <article>.
NESTED = [
    ("<article><article>teaser</article>", "</article>"),
    ("<div class='lead content'><div>intro</div><DIV><div>deep</div></DIV>", "<div>tail</div></div><div>after</div>"),
    ('<table><tr><td data-x=1 id="content"><table><tr><td>cell</td></tr></table>', "</td></tr></table>"),
    ("<main class=x><main-nav>n</main-nav>", "<p>never closed"),
    ("<section role = 'main'><section></section><p>s</p>", "</section></section>"),
]

NESTED_SQL = "SELECT page_id, CASE page_id % 5 " + " ".join(
    f"WHEN {k} THEN replace(replace(html, '<article>', {S.q(a)}), '</article>', {S.q(b)})" for k, (a, b) in enumerate(NESTED)
) + " END AS html FROM pages"

NESTED_MAIN_SQL = f"""
WITH RECURSIVE v AS (SELECT page_id AS k, html FROM ({NESTED_SQL})),
{P.tree('v').strip()}
SELECT k AS page_id, k % 5 AS shape, main_html FROM page
"""


@register("h4_nested_main", NESTED_MAIN_SQL)
def nested_main(spark, sf_dir):
    """The main element up to its own end tag, in five shapes of nesting."""
    pages = read_table(spark, sf_dir, "pages")
    shape = F.col("page_id") % 5
    html = F.coalesce(*(
        F.when(shape == k, F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit(a)), F.lit("</article>"), F.lit(b)))
        for k, (a, b) in enumerate(NESTED)
    ))
    v = H.with_content(pages.select("page_id", shape.alias("shape"), html.alias("html")), "html", "t_")
    m = F.col("t_main")
    return v.select("page_id", "shape", F.when(m.isNotNull(), T.inner_html("t_", m)).alias("main_html"))


# What pages hold besides: nested chrome, void elements with a selector's class, lists, links and code in all places.
SHAPES = [
    "<nav>a<nav>b</nav>c</nav>d <article>",
    "<input class=\"content\"><p>a</p><article><p><b>x</b></p><ul><li>one</li> <li>two <b>b</b><ul><li>three</li></ul></li></ul>",
    "<article><h2>A <a href='/h'>link</a></h2><p><a href=/p/>only</a></p><p>t <a href='/q?a=1&amp;b'>q</a> <a>none</a></p><header>h<p>x</header>",
    "<article><pre><code>x &lt; y</code></pre><a href='/c'><code>z</code></a><ol>loose</ol><ul>gap<li><p>i</p><li>j</ul><p>open<aside><div>no</aside>",
]
SHAPES_SQL = "SELECT page_id, replace(html, '<article>', CASE page_id % 4 " + " ".join(
    f"WHEN {k} THEN {S.q(a)}" for k, a in enumerate(SHAPES)) + " END) AS html FROM pages"


@register("h3_h6_shapes", HTML_JOBS_SQL.replace(VARIANT_SQL, SHAPES_SQL))
def shapes(spark, sf_dir):
    """H2, H3, H4 and H6 over pages that begin with nested chrome, void elements, lists, links and code."""
    pid = F.col("page_id")
    begin = F.coalesce(*(F.when(pid % 4 == k, F.lit(a)) for k, a in enumerate(SHAPES)))
    pages = read_table(spark, sf_dir, "pages")
    return _html_jobs(pages.select("page_id", F.replace(F.col("html"), F.lit("<article>"), begin).alias("html")))


VISIBLE_SQL = f"""
SELECT page_id, {S.visible_text('html')} AS visible_text,
       length({S.strip(S.visible_text('html'))})::BIGINT AS visible_len
FROM pages
"""


@register("h5_visible_text", VISIBLE_SQL)
def visible_text(spark, sf_dir):
    """H5: text without head, scripts, styles and comments."""
    p = read_table(spark, sf_dir, "pages").select("page_id", H.visible_text("html").alias("visible_text"))
    return p.withColumn("visible_len", F.length(py_strip("visible_text")).cast("long"))


# ----------------------------------------------------------- classification

TITLED_SQL = """
SELECT doc_id,
  'https://' || CASE WHEN doc_id % 17 = 0 THEN 'medium.com' WHEN doc_id % 19 = 0 THEN 'www.linkedin.com'
                     WHEN doc_id % 23 = 0 THEN 'reddit.com' ELSE source || '.example' END
    || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
  substring(text, 1, 60) || CASE WHEN ['podcast', 'call', 'book', 'update', ''][doc_id % 5 + 1] <> ''
       THEN ' ' || ['podcast', 'call', 'book', 'update', ''][doc_id % 5 + 1] ELSE '' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN text || ' 1. 2. 3. ' WHEN doc_id % 3 = 1 THEN 'how to ' || text || ' guide: '
       ELSE text END AS content
FROM documents
"""

CLASSIFY_SQL = f"""
WITH t AS ({TITLED_SQL})
SELECT doc_id, {S.classify('url', 'title', 'content')} AS content_type,
       {S.is_tutorial('content')} AS is_tutorial
FROM t
"""


@register("c6_classify", CLASSIFY_SQL)
def classify_items(spark, sf_dir):
    """Platform rules, keyword rules, tutorial rule, default 'blog'."""
    t = titled_items(read_table(spark, sf_dir, "documents"))
    return t.select(
        "doc_id",
        CL.classify("url", "title", "content").alias("content_type"),
        CL.is_tutorial("content").alias("is_tutorial"),
    )


MD_TITLE_SQL = f"""
WITH t AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '# ' || text
                      WHEN doc_id % 4 = 1 THEN 'intro' || chr(10) || '   #  ' || chr(10) || '  # ' || text
                      WHEN doc_id % 4 = 2 THEN text
                      ELSE '#nospace' || chr(10) || text END AS content,
         CASE WHEN doc_id % 6 = 0 THEN substring(text, 1, 20) END AS meta_title
  FROM documents
)
SELECT doc_id, {S.title_from_markdown('content')} AS md_title,
       coalesce(nullif(meta_title, ''), {S.title_from_markdown('content')}) AS title
FROM t
"""


@register("c4_c5_titles", MD_TITLE_SQL)
def markdown_titles(spark, sf_dir):
    """C4 first '# ' line as title, C5 metadata title first."""
    d = read_table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    content = (
        F.when(did % 4 == 0, F.concat(F.lit("# "), "text"))
        .when(did % 4 == 1, F.concat(F.lit("intro\n   #  \n  # "), "text"))
        .when(did % 4 == 2, F.col("text"))
        .otherwise(F.concat(F.lit("#nospace\n"), "text"))
    )
    t = d.select(did, content.alias("content"), F.when(did % 6 == 0, F.substring("text", 1, 20)).alias("meta_title"))
    return t.select(
        "doc_id",
        CL.title_from_markdown("content").alias("md_title"),
        CL.title_or_markdown("meta_title", "content").alias("title"),
    )
