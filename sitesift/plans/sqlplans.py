"""Oracle SQL plans (DuckDB) shared by several catalog entries."""

from __future__ import annotations

from . import sqlparts as S

HOST = S.url_netloc("url")


def fetches_plain() -> str:
    """S1 in SQL: pages as fetches with status 200."""
    return (
        f"SELECT {HOST} AS site, page_id, url, 200 AS status, html AS body, "
        "CAST(NULL AS VARCHAR) AS rendered_html, CAST(NULL AS VARCHAR) AS render_error FROM pages"
    )


def fetches_derived() -> str:
    b = "html"
    b = f"CASE WHEN page_id % 7 = 3 THEN {b} || ' page not found ' ELSE {b} END"
    b = f"CASE WHEN page_id % 7 = 4 THEN {b} || ' error 404 ' ELSE {b} END"
    b = f"CASE WHEN page_id % 11 = 4 THEN {b} || ' __next ' ELSE {b} END"
    b = f"CASE WHEN page_id % 13 = 5 THEN substring({b}, 1, 500) ELSE {b} END"
    return (
        f"SELECT {HOST} AS site, page_id, url, "
        "CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 500 WHEN page_id % 10 = 2 THEN 204 ELSE 200 END AS status, "
        f"{b} AS body, CASE WHEN page_id % 3 <> 0 THEN html END AS rendered_html, "
        "CAST(NULL AS VARCHAR) AS render_error FROM pages"
    )


# Fixed values of the element tree, written out here on their own.
_VOID = ("'area','base','basefont','bgsound','br','col','command','embed','frame','hr','image','img','input','isindex','keygen','link',"
         "'menuitem','meta','nextid','param','source','spacer','track','wbr'")
_NOISE = r"(?is)<!--.*?-->|<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>"
_TAG = r"""(?i)</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>|<[!?][^>]*>"""
_SELECTORS = ("name = 'main'", "name = 'article'", "role = 'main'", "list_contains(classes, 'content')", "list_contains(classes, 'main-content')",
              "list_contains(classes, 'post-content')", "list_contains(classes, 'article-content')", "list_contains(classes, 'blog-content')",
              "id = 'content'", "id = 'main'", "list_contains(classes, 'entry-content')", "list_contains(classes, 'post-body')")
_TITLES = ("name = 'h1'", "list_contains(classes, 'post-title')", "list_contains(classes, 'article-title')",
           "list_contains(classes, 'entry-title')", "name = 'title'")


def _attr(name: str) -> str:
    x = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*))"""
    return f"CASE WHEN regexp_matches(tag, {S.q(x)}) THEN " + " || ".join(f"regexp_extract(tag, {S.q(x)}, {g})" for g in (1, 2, 3)) + " END"


def _first(conditions, what: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {k}" for k, c in enumerate(conditions)) + f" END AS {what}"


def tree(copies: str) -> str:
    """CTEs over ``copies`` (k, html): ``page`` (k, title, main_html, main_md,
    block_html, block_md, stripped), by sets of (text, open elements) instead
    of folds; a recursive walk keeps the stack of open elements."""
    return f"""
xc AS (SELECT k, regexp_replace(html, {S.q(_NOISE)}, '', 'g') AS html FROM {copies} WHERE html IS NOT NULL),
xa AS (SELECT k, regexp_extract_all(html, {S.q(_TAG)}) AS g, regexp_split_to_array(html, {S.q(_TAG)}) AS s FROM xc),
xt AS MATERIALIZED (
  SELECT k, i, tag, lower(regexp_extract(tag, '^</?([^\\s/>]+)', 1)) AS name, text,
         CASE WHEN i < 0 THEN 0 WHEN tag LIKE '</%' THEN -1
              WHEN lower(regexp_extract(tag, '^</?([^\\s/>]+)', 1)) IN ({_VOID}) OR tag LIKE '<!%' OR tag LIKE '<?%'
                OR (tag LIKE '%/>' AND NOT regexp_matches(tag, '=\\s*[^\\s"''>]+/>$')) THEN 0 ELSE 1 END AS kind
  FROM (SELECT k, unnest(range(-1, len(g))) AS i, CASE WHEN i >= 0 THEN g[i + 1] END AS tag, s[i + 2] AS text FROM xa)),
xw AS (  -- open elements after each tag, the innermost last
  SELECT k, -1::BIGINT AS i, []::BIGINT[] AS open, []::VARCHAR[] AS names FROM xa
  UNION ALL
  SELECT t.k, t.i,
         CASE WHEN kind = 1 THEN list_append(open, t.i) WHEN kind = 0 OR NOT list_contains(names, name) THEN open
              ELSE open[1:len(names) - list_position(list_reverse(names), name)] END,
         CASE WHEN kind = 1 THEN list_append(names, name) WHEN kind = 0 OR NOT list_contains(names, name) THEN names
              ELSE names[1:len(names) - list_position(list_reverse(names), name)] END
  FROM xw JOIN xt t ON t.k = xw.k AND t.i = xw.i + 1),
xo AS MATERIALIZED (
  SELECT t.*, w.open, list_has_any(w.names, ['nav', 'footer', 'header', 'aside']) AS chrome,
         coalesce(list_has_any(lag(w.names) OVER (PARTITION BY t.k ORDER BY t.i), ['nav', 'footer', 'header', 'aside']), false) AS was_chrome,
         lag(w.open) OVER (PARTITION BY t.k ORDER BY t.i) AS was
  FROM xt t JOIN xw w ON w.k = t.k AND w.i = t.i),
xk AS MATERIALIZED (  -- an end tag goes with the chrome that it closes by name
  SELECT *, NOT chrome AS text_kept,
         i >= 0 AND NOT chrome AND NOT (kind = 0 AND name IN ('nav', 'footer', 'header', 'aside'))
           AND NOT (was_chrome AND kind = -1 AND name IN ('nav', 'footer', 'header', 'aside')) AS tag_kept,
         {S.decode("CASE WHEN NOT chrome THEN coalesce(text, '') ELSE '' END")} AS plain
  FROM xo),
xe AS MATERIALIZED (
  SELECT k, i, name, kind, tag, open, {S.decode("coalesce(" + _attr('href') + ", '')")} AS href, {_attr('id')} AS id, {_attr('role')} AS role,
         regexp_split_to_array(coalesce({_attr('class')}, ''), '\\s+') AS classes
  FROM xk WHERE tag_kept AND kind >= 0),
xs AS (SELECT k, i, {_first(_SELECTORS, 'rank')} FROM xe),
xm AS (SELECT k, arg_min(i, (rank, i)) AS m FROM xs WHERE rank IS NOT NULL GROUP BY k),
xb AS (  -- outermost blocks
  SELECT e.k, e.i AS m, (SELECT coalesce(sum(length(plain)), 0) FROM xk WHERE xk.k = e.k AND list_contains(xk.open, e.i)) AS size
  FROM xe e WHERE name IN ('div', 'section') AND kind = 1
    AND NOT EXISTS (SELECT 1 FROM xe o WHERE o.k = e.k AND o.i <> e.i AND o.name IN ('div', 'section') AND list_contains(e.open, o.i))),
xbest AS (SELECT k, arg_min(m, (-size, m)) AS m FROM xb WHERE size > 200 GROUP BY k),
xr AS (SELECT 'main' AS part, * FROM xm UNION ALL SELECT 'block', * FROM xbest),
xin AS MATERIALIZED (  -- tags and texts inside the chosen element
  SELECT r.part, r.m, x.* FROM xr r JOIN xk x ON x.k = r.k AND (list_contains(x.open, r.m) OR list_contains(x.was, r.m))),
xhtml AS (
  SELECT part, k, string_agg(CASE WHEN i > m AND tag_kept AND list_contains(was, m) AND (list_contains(open, m)) THEN tag ELSE '' END
                             || CASE WHEN text_kept AND list_contains(open, m) THEN text ELSE '' END, '' ORDER BY i) AS html
  FROM xin GROUP BY part, k),
xd AS MATERIALIZED (  -- elements inside, with the tag that ends them, their texts and where these stand
  SELECT part, m, e.k, e.i, e.name, e.kind, e.href,
         e.open[list_position(e.open, m) + 1:] AS path,
         coalesce((SELECT min(j.i) FROM xk j WHERE j.k = e.k AND j.i > e.i AND NOT list_contains(j.open, e.i)),
                  (SELECT max(j.i) + 1 FROM xk j WHERE j.k = e.k)) AS ends,
         (SELECT list(j.i ORDER BY j.i) FROM xk j WHERE j.k = e.k AND list_contains(j.open, e.i) AND j.text_kept AND j.text <> '') AS texts
  FROM xr r JOIN xe e ON e.k = r.k AND list_contains(e.open, r.m) AND e.i > r.m),
xh AS (SELECT part, k, i FROM xd h WHERE name IN ('h1','h2','h3','h4','h5','h6') AND kind = 1
       AND NOT EXISTS (SELECT 1 FROM xd o WHERE o.part = h.part AND o.k = h.k AND o.i <> h.i AND o.name IN ('h1','h2','h3','h4','h5','h6') AND list_contains(h.path, o.i))),
xp AS (  -- paragraphs whose only content is one text: all elements inside hold it
  SELECT p.part, p.k, p.i FROM xd p WHERE p.name = 'p' AND p.kind = 1 AND len(p.texts) = 1
    AND NOT EXISTS (SELECT 1 FROM xd c WHERE c.part = p.part AND c.k = p.k AND c.i > p.i AND c.i < p.ends
                    AND (c.kind = 0 OR coalesce(len(c.texts), 0) = 0))
    AND NOT EXISTS (SELECT 1 FROM xh WHERE xh.part = p.part AND xh.k = p.k AND list_contains(p.path, xh.i))),
xp1 AS (SELECT x.* FROM xp x JOIN xd d USING (part, k, i) WHERE NOT EXISTS (
          SELECT 1 FROM xp o WHERE o.part = x.part AND o.k = x.k AND o.i <> x.i AND list_contains(d.path, o.i))),
xf AS MATERIALIZED (  -- elements that are no plain text in a heading or such a paragraph
  SELECT d.* FROM xd d WHERE d.kind = 1
    AND NOT EXISTS (SELECT 1 FROM xh o WHERE o.part = d.part AND o.k = d.k AND o.i <> d.i AND list_contains(d.path, o.i))
    AND NOT EXISTS (SELECT 1 FROM xp1 o WHERE o.part = d.part AND o.k = d.k AND o.i <> d.i AND list_contains(d.path, o.i))),
xl0 AS (SELECT * FROM xf l WHERE name IN ('ul', 'ol') AND EXISTS (
          SELECT 1 FROM xf li WHERE li.part = l.part AND li.k = l.k AND li.name = 'li' AND list_contains(li.path, l.i))),
xl AS (SELECT * FROM xl0 l WHERE NOT EXISTS (SELECT 1 FROM xf o WHERE o.part = l.part AND o.k = l.k AND o.i <> l.i AND o.name IN ('ul', 'ol') AND list_contains(l.path, o.i))),
xg AS MATERIALIZED (SELECT f.* FROM xf f WHERE NOT EXISTS (SELECT 1 FROM xf l WHERE l.part = f.part AND l.k = f.k AND l.name IN ('ul', 'ol') AND list_contains(f.path, l.i))),
xla AS (SELECT * FROM xg a WHERE name = 'a' AND href <> '' AND NOT EXISTS (
          SELECT 1 FROM xg o WHERE o.part = a.part AND o.k = a.k AND o.i <> a.i AND o.name = 'a' AND o.href <> '' AND list_contains(a.path, o.i))),
xco AS (SELECT * FROM xg c WHERE name IN ('code', 'pre')
          AND NOT EXISTS (SELECT 1 FROM xg o WHERE o.part = c.part AND o.k = c.k AND o.i <> c.i AND o.name IN ('code', 'pre') AND list_contains(c.path, o.i))
          AND NOT EXISTS (SELECT 1 FROM xla o WHERE o.part = c.part AND o.k = c.k AND list_contains(c.path, o.i))),
xy AS MATERIALIZED (  -- texts and marks: at tag i, ends (0, inner first) before beginnings (1) before the text (2)
  SELECT part, k, i, 2 AS step, 0 AS sub, plain AS out, open[list_position(open, m) + 1:] AS path, false AS fancy FROM xin WHERE list_contains(open, m)
  UNION ALL SELECT part, k, i, 1, 0, repeat('#', substr(name, 2)::INTEGER) || ' ', path, false FROM xd JOIN xh USING (part, k, i)
  UNION ALL SELECT part, k, ends, 0, -i, chr(10) || chr(10), path, false FROM xd JOIN xh USING (part, k, i)
  UNION ALL SELECT part, k, ends, 0, -i, chr(10) || chr(10), path, false FROM xd JOIN xp1 USING (part, k, i)
  UNION ALL SELECT part, k, i, 1, 0, '`', path, true FROM xco UNION ALL SELECT part, k, ends, 0, -i, '`', path, true FROM xco
  UNION ALL SELECT part, k, texts[1], 1, 1, '[', path, true FROM xla WHERE len(texts) > 0
  UNION ALL SELECT part, k, ends, 0, -i, '](' || href || ')', path, true FROM xla WHERE len(texts) > 0),
xli AS (  -- the lines of a list: every item's texts and marks
  SELECT l.part, l.k, l.i AS of_list, li.i AS item, '- ' || coalesce(string_agg(y.out, '' ORDER BY y.i, y.step, y.sub), '') || chr(10) AS line
  FROM xl l JOIN xf li ON li.part = l.part AND li.k = l.k AND li.name = 'li' AND list_contains(li.path, l.i)
  LEFT JOIN xy y ON y.part = l.part AND y.k = l.k AND NOT y.fancy AND list_contains(y.path, li.i) AND NOT (y.step = 0 AND y.i = li.i)
  GROUP BY l.part, l.k, l.i, li.i),
xz AS (
  SELECT part, k, i, step, sub, out FROM xy WHERE NOT EXISTS (
    SELECT 1 FROM xl WHERE xl.part = xy.part AND xl.k = xy.k AND list_contains(xy.path, xl.i))
  UNION ALL SELECT part, k, of_list, 1, 2, string_agg(line, '' ORDER BY item) || chr(10) FROM xli GROUP BY part, k, of_list),
xmd AS (SELECT part, k, string_agg(out, '' ORDER BY i, step, sub) AS md FROM xz GROUP BY part, k),
xtt AS (
  {" UNION ALL ".join(f"SELECT k, {r} AS r, min(i) AS i FROM xe WHERE {c} GROUP BY k" for r, c in enumerate(_TITLES))}),
xtx AS (
  SELECT t.k, t.r, (SELECT {S.strip("string_agg(plain, '' ORDER BY xk.i)")} FROM xk WHERE xk.k = t.k AND list_contains(xk.open, t.i)) AS title FROM xtt t),
page AS (
  SELECT c.k, coalesce((SELECT arg_min(title, r) FROM xtx WHERE xtx.k = c.k AND title <> ''), 'Untitled') AS title,
         mh.html AS main_html, CASE WHEN xm.m IS NOT NULL THEN coalesce(mm.md, '') END AS main_md, bh.html AS block_html, bm.md AS block_md,
         (SELECT string_agg(CASE WHEN tag_kept THEN tag ELSE '' END || CASE WHEN text_kept THEN text ELSE '' END, '' ORDER BY i) FROM xk WHERE xk.k = c.k) AS stripped
  FROM xc c LEFT JOIN xm ON xm.k = c.k
  LEFT JOIN xhtml mh ON mh.k = c.k AND mh.part = 'main' LEFT JOIN xmd mm ON mm.k = c.k AND mm.part = 'main'
  LEFT JOIN xhtml bh ON bh.k = c.k AND bh.part = 'block' LEFT JOIN xmd bm ON bm.k = c.k AND bm.part = 'block')"""


def extracted(fetches_sql: str, use_browser: bool) -> str:
    """SQL mirror of operators.extract.extract -> site, page_id, url, gate, source, title, content, content_type."""
    ub = "true" if use_browser else "false"

    def content(x: str) -> str:
        return f"coalesce({S.accepted(x + '.main_md')}, {S.accepted(x + '.block_md')})"

    return f"""
f0 AS ({fetches_sql}),
f AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM f0),
g AS MATERIALIZED (SELECT *, {S.fetch_gate('status', 'strlen(body)', 'body')} AS gate FROM f),
copies AS (
  SELECT 2 * rid AS k, body AS html FROM g WHERE gate = 'extract'
  UNION ALL SELECT 2 * rid + 1, rendered_html FROM g WHERE {ub} AND gate NOT IN ('drop', 'error') AND rendered_html <> '' AND render_error IS NULL),
{tree('copies').strip()},
h AS (SELECT g.*, {content('p')} AS h_content, p.title AS h_page_title FROM g LEFT JOIN page p ON p.k = 2 * g.rid),
h1 AS (SELECT *, coalesce(nullif(h_page_title, 'Untitled'), {S.title_from_markdown('h_content')}) AS h_title FROM h),
h2 AS (SELECT *, h_content IS NOT NULL AND NOT {S.is_error_content('h_content', 'h_title')} AS h_ok FROM h1),
r AS (
  SELECT h2.*, NOT h_ok AND p.k IS NOT NULL AND NOT {S.is_error_page('rendered_html')} AS r_tried, {content('p')} AS r_found, p.title AS r_page_title
  FROM h2 LEFT JOIN page p ON p.k = 2 * h2.rid + 1),
r2 AS (SELECT *, CASE WHEN r_tried THEN r_found END AS r_content FROM r),
r3 AS (SELECT *, coalesce(nullif(r_page_title, 'Untitled'), {S.title_from_markdown('r_content')}) AS r_title FROM r2),
r4 AS (SELECT *, r_content IS NOT NULL AND NOT {S.is_error_content('r_content', 'r_title')} AS r_ok FROM r3),
ex AS (
  SELECT site, page_id, url, status, gate,
         CASE WHEN h_ok THEN 'http' WHEN r_ok THEN 'rendered' END AS source,
         CASE WHEN h_ok THEN h_title WHEN r_ok THEN r_title END AS title,
         CASE WHEN h_ok THEN h_content WHEN r_ok THEN r_content END AS content
  FROM r4
),
items AS (
  SELECT site, page_id AS ord, title, content, {S.classify('url', 'title', 'content')} AS content_type, url AS source_url
  FROM ex WHERE source IS NOT NULL
)"""


def dedup(items_cte: str) -> str:
    """Template exclusion + representative + first-wins, written with windows."""
    return f"""
dh AS (SELECT *, md5(content) AS content_md5, {S.is_likely_blog_url('source_url')} AS is_blog FROM {items_cte}),
dcnt AS (SELECT site, content_md5, count(*) AS cnt, min(ord) AS first_ord FROM dh GROUP BY site, content_md5),
dtot AS (SELECT site, count(*) AS total FROM dh GROUP BY site),
dqual AS (
  SELECT c.site, c.content_md5, c.first_ord FROM dcnt c JOIN dtot t ON c.site = t.site
  WHERE c.cnt > 3 AND c.cnt >= t.total * (CASE WHEN t.total <= 10 THEN 0.5 ELSE 0.3 END)::DOUBLE
),
dtpl AS (SELECT site, arg_max(content_md5, first_ord) AS tpl FROM dqual GROUP BY site),
dfilt AS (
  SELECT dh.* FROM dh LEFT JOIN dtpl ON dh.site = dtpl.site
  WHERE dtpl.tpl IS NULL OR dh.content_md5 <> dtpl.tpl OR NOT dh.is_blog
),
demptied AS (SELECT site FROM dtpl WHERE site NOT IN (SELECT site FROM dfilt)),
drep AS (
  SELECT * REPLACE ('[Template Content] ' || title AS title) FROM dh
  WHERE site IN (SELECT site FROM demptied)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) = 1
),
dkept AS (
  SELECT * FROM dfilt QUALIFY row_number() OVER (PARTITION BY site, content_md5 ORDER BY ord) = 1
),
deduped AS (SELECT * EXCLUDE (is_blog) FROM dkept UNION ALL SELECT * EXCLUDE (is_blog) FROM drep)"""


def chunked(items_cte: str, max_size: int) -> str:
    """Chunking with a recursive CTE over paragraphs (independent of the fold)."""
    m = int(max_size)
    return f"""
cp AS (
  SELECT site, ord, title, content, content_type, source_url,
         string_split(content, chr(10) || chr(10)) AS paras
  FROM {items_cte}
),
cpx AS (
  SELECT site, ord, unnest(paras) AS para, generate_subscripts(paras, 1) AS pi FROM cp
),
cwalk AS (
  SELECT site, ord, pi, para, 0 AS k, length(para)::BIGINT + 2 AS run FROM cpx WHERE pi = 1
  UNION ALL
  SELECT x.site, x.ord, x.pi, x.para,
         CASE WHEN w.run + length(x.para) > {m} THEN w.k + 1 ELSE w.k END,
         CASE WHEN w.run + length(x.para) > {m} THEN length(x.para)::BIGINT ELSE w.run + length(x.para) + 2 END
  FROM cwalk w JOIN cpx x ON x.site = w.site AND x.ord = w.ord AND x.pi = w.pi + 1
),
cchunks AS (
  SELECT site, ord, k, string_agg(para, chr(10) || chr(10) ORDER BY pi) AS piece
  FROM cwalk GROUP BY site, ord, k
),
cstats AS (
  SELECT site, ord, count(*) AS n, bool_and(length(piece) > 1000) AS all_big FROM cchunks GROUP BY site, ord
),
cdecide AS (
  SELECT cp.*, (length(content) > {m} * 1.5 AND s.n <= 3 AND s.all_big) AS split, s.n
  FROM cp JOIN cstats s ON cp.site = s.site AND cp.ord = s.ord
),
chunked AS (
  SELECT d.site, d.ord, c.k + 1 AS part,
         CASE WHEN d.n > 1 THEN d.title || ' (Part ' || (c.k + 1) || ')' ELSE d.title END AS title,
         c.piece AS content, d.content_type, d.source_url
  FROM cdecide d JOIN cchunks c ON d.site = c.site AND d.ord = c.ord WHERE d.split
  UNION ALL
  SELECT site, ord, 1 AS part, title, content, content_type, source_url FROM cdecide WHERE NOT split
)"""
