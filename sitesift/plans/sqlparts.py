"""DuckDB SQL fragments used by the oracle queries.

The oracle SQL restates each rule in DuckDB's dialect (RE2 regexes,
``list_reduce`` folds, ``\\1`` group references) so that the driver can run
it next to the Spark plan. Helpers here only build SQL text.
"""

from __future__ import annotations

import html.entities
import json

from ..functions import classify as CL
from ..functions import html as H
from ..functions import quality as Q
from ..functions import text as T
from ..functions import urls as U

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(T.PY_WHITESPACE)})"


def any_(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def n_present(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


def rx(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {q(pat)})"


def rrep(x: str, pat: str, rep: str) -> str:
    """Global regexp_replace; ``rep`` is SQL (may use \\1)."""
    return f"regexp_replace({x}, {q(pat)}, {rep}, 'g')"


def rext(x: str, pat: str, g: int) -> str:
    return f"regexp_extract({x}, {q(pat)}, {g})"


_ENTITY = "&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([^\\t\\n\\f <&#;]{1,32})(;?))"
_NAMES = json.dumps({k: v for k, v in html.entities.html5.items() if k.endswith(";")})
_OLD = "^(" + "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)) + ")"
_WINDOWS = "[" + ", ".join(q(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(128, 160)) + "]"


def decode(x: str) -> str:
    """Character references, one by one, between the texts around them."""
    part = [f"regexp_extract(e, {q(_ENTITY)}, {g})" for g in (1, 2, 3, 4)]
    digits = f"ltrim({part[0]} || {part[1]}, '0')"
    code = (f"CASE WHEN {part[0]} || {part[1]} = '' THEN NULL WHEN length({digits}) > 8 THEN 9999999 "
            f"WHEN {part[0]} <> '' THEN coalesce(nullif({digits}, ''), '0')::BIGINT "
            f"ELSE ('0x' || coalesce(nullif({digits}, ''), '0'))::BIGINT END")
    char = (f"list_transform([{code}], lambda n: CASE WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN n BETWEEN 128 AND 159 THEN {_WINDOWS}[n - 127] "
            f"WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' "
            f"WHEN n IS NOT NULL THEN chr(n::INTEGER) END)[1]")
    def named(n: str) -> str:
        return f"json_extract_string({q(_NAMES)}, '$.\"' || {n} || ';\"')"

    old = f"regexp_extract({part[2]}, {q(_OLD)}, 1)"
    plain = f"regexp_matches({part[2]}, '^[A-Za-z0-9]+$')"
    one = (f"coalesce({char}, CASE WHEN {part[3]} = ';' AND {plain} THEN {named(part[2])} END, "
           f"CASE WHEN {old} <> '' THEN {named(old)} || substr({part[2]}, length({old}) + 1) || {part[3]} END, e)")
    joined = (f"array_to_string(list_transform(list_zip(regexp_split_to_array(t, {q(_ENTITY)}), regexp_extract_all(t, {q(_ENTITY)}, 0)), "
              f"lambda z: z[1] || coalesce(list_transform([z[2]], lambda e: CASE WHEN e IS NOT NULL THEN {one} END)[1], '')), '')")
    return f"list_transform([{x}], lambda t: CASE WHEN contains(t, '&') THEN {joined} ELSE t END)[1]"


def text_of(x: str) -> str:
    return decode(rrep(x, r"<[^>]*>", "''"))


def ellipsis(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


def collapse_ws(x: str) -> str:
    return rrep(strip(x), T.PY_WS_CLASS + "+", "' '")


def py_split(x: str) -> str:
    return (
        f"CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] "
        f"ELSE regexp_split_to_array({strip(x)}, {q(T.PY_WS_CLASS + '+')}) END"
    )


def count_substr(x: str, sub: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(sub)}, ''))) // {len(sub)})"


# --------------------------------------------------------------------- html

# Anchor start tags with a link: double, single or no quotes.
_A_OPEN = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>"""
_A_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def anchors(x: str, from_nav: str = "false") -> str:
    """List of (from_nav, a = start tag, body = text up to the end tag or the next anchor)."""
    return (
        f"(SELECT list_transform(range(1, len(g) + 1), lambda i: struct_pack(from_nav := {from_nav}, a := g[i], "
        f"body := regexp_replace(s[i + 1], '(?is)</a\\s*>.*', ''))) "
        f"FROM (SELECT regexp_extract_all({x}, {q(_A_OPEN)}, 0) AS g, regexp_split_to_array({x}, {q(_A_OPEN)}) AS s))"
    )


def href(a: str) -> str:
    return decode(" || ".join(f"regexp_extract({a}, {q(_A_HREF)}, {g})" for g in (1, 2, 3)))


def remove_noise(x: str) -> str:
    return rrep(x, H.NOISE_RE, "''")


def visible_text(x: str) -> str:
    return text_of(rrep(remove_noise(x), H.HEAD_RE, "''"))


def accepted(text: str) -> str:
    return f"CASE WHEN length({strip(text)}) > {Q.ITEM_MIN_CHARS} THEN {text} END"


# ------------------------------------------------------------------ quality

def is_valid_html(x: str) -> str:
    low = f"lower({x})"
    n = n_present(low, Q.CONTENT_MARKERS)
    return f"({any_(low, Q.HTML_STRUCTURE_MARKERS)} AND {n} >= 2 AND ({count_substr(low, '<script')} = 0 OR {n} >= 1))"


def is_error_page(x: str) -> str:
    low = f"lower({x})"
    vis = f"lower({visible_text(x)})"
    spa = f"({any_(vis, Q.SPA_ERROR_PHRASES)} AND length({strip(vis)}) < {Q.SPA_VISIBLE_MAX})"
    col = collapse_ws(low)
    normal = f"({any_(low, Q.STRONG_ERROR_PHRASES)} OR (length({col}) < {Q.WEAK_ERROR_MAX} AND {any_(col, Q.WEAK_ERROR_WORDS)}))"
    return f"(CASE WHEN {any_(low, Q.SPA_MARKERS)} THEN {spa} ELSE {normal} END)"


def is_error_content(content: str, title: str) -> str:
    c, t = f"lower({content})", f"lower({title})"
    short = f"(length({strip(content)}) < 200 AND (contains({c}, 'greetings flesh bag') OR contains({c}, 'error 404')))"
    return f"({any_(t, Q.TITLE_ERROR_PHRASES)} OR {short} OR (contains({c}, 'greetings flesh bag') AND contains({c}, '404 error')))"


def fetch_gate(status: str, nbytes: str, html: str) -> str:
    return (
        f"(CASE WHEN {status} >= 400 THEN 'drop' WHEN {status} IS NULL OR {status} <> 200 THEN 'other' "
        f"WHEN {is_error_page(html)} THEN 'error' WHEN {nbytes} < {Q.MIN_BODY_BYTES} THEN 'small' "
        f"WHEN NOT {is_valid_html(html)} THEN 'invalid' ELSE 'extract' END)"
    )


# ----------------------------------------------------------------- classify

def is_tutorial(content: str) -> str:
    low = f"lower({content})"
    words = py_split(low)
    numbered = f"len(list_filter(({words})[1:{CL.NUMBERED_WINDOW}], lambda w: regexp_matches(w, {q(CL.NUMBERED_STEP_RE)})))"
    return f"(len({words}) > {CL.TUTORIAL_MIN_WORDS} AND ({n_present(low, CL.TUTORIAL_PHRASES)} >= 2 OR {numbered} >= 3))"


def classify(url: str, title: str, content: str) -> str:
    u, t = f"lower({url})", f"lower({title})"
    parts = [f"WHEN contains({u}, {q(n)}) THEN {q(lbl)}" for n, lbl in CL.PLATFORM_RULES]
    parts += [f"WHEN {any_(u, ws)} OR {any_(t, ws)} THEN {q(lbl)}" for lbl, ws in CL.KEYWORD_RULES]
    return f"(CASE {' '.join(parts)} WHEN {is_tutorial(content)} THEN 'tutorial' ELSE 'blog' END)"


def title_from_markdown(content: str) -> str:
    first = f"list_filter(string_split({content}, {NL}), lambda l: starts_with({strip('l')}, '# '))[1]"
    return f"coalesce({strip(f'substring({strip(first)}, 3)')}, 'Untitled')"


# --------------------------------------------------------------------- urls

def url_part(x: str, g: int) -> str:
    return rext(x, U.URL_RE, g)


def url_scheme(x: str) -> str:
    return f"lower({url_part(x, 1)})"


def url_netloc(x: str) -> str:
    return url_part(x, 2)


def url_path(x: str) -> str:
    return rrep(url_part(x, 3), r";[^/]*$", "''")


def url_params(x: str) -> str:
    return rext(url_part(x, 3), r";([^/]*)$", 1)


def url_query(x: str) -> str:
    return url_part(x, 4)


def url_fragment(x: str) -> str:
    return url_part(x, 5)


def path_depth(p: str) -> str:
    return f"(length({p}) - length(replace({p}, '/', '')))"


def path_parts(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda z: z <> '')"


def any_re(x: str, pats) -> str:
    return rx(x, "|".join(pats))


def is_content_url(url: str, domain: str) -> str:
    p = f"lower({url_path(url)})"
    deep = f"(length({p}) > 1 AND {p} <> '/' AND {path_depth(p)} >= 2 AND NOT {any_(p, U.CORPORATE_SKIP)})"
    return (
        f"(CASE WHEN {url_netloc(url)} <> {domain} THEN false WHEN {any_(p, U.CONTENT_SKIP)} THEN false "
        f"WHEN {any_(p, U.CONTENT_ACCEPT)} OR {any_re(p, U.CONTENT_ACCEPT_RE)} THEN true ELSE {deep} END)"
    )


def is_section_content_url(url: str, section: str, domain: str) -> str:
    p = f"lower({url_path(url)})"
    sp = f"lower({url_path(section)})"
    deeper = f"(starts_with({p}, {sp}) AND {p} <> {sp} AND len({path_parts(p)}) > len({path_parts(sp)}))"
    return (
        f"(CASE WHEN {url_netloc(url)} <> {domain} THEN false WHEN {any_(p, U.SECTION_SKIP)} THEN false "
        f"WHEN {deeper} THEN true ELSE ({any_re(p, U.SECTION_ACCEPT_RE)} OR {any_(p, U.SECTION_ACCEPT)}) END)"
    )


def is_rendered_content_url(url: str) -> str:
    p = f"lower({url_path(url)})"
    full = f"lower({url})"
    sub = f"contains({full}, 'substack.com')"
    return (
        f"(CASE WHEN {any_(p, U.RENDERED_SKIP)} THEN false "
        f"WHEN {sub} AND (contains({p}, '/comments') OR contains({p}, '/t/')) THEN false "
        f"WHEN {sub} AND contains({p}, '/p/') AND NOT ends_with({p}, '/comments') THEN true "
        f"WHEN {any_(p, U.RENDERED_ACCEPT)} THEN true "
        f"ELSE (length({p}) > 1 AND {p} <> '/' AND {path_depth(p)} >= 2) END)"
    )


def is_likely_blog_url(url: str) -> str:
    return any_(f"lower({url})", U.BLOG_URL_INDICATORS)


def route(url: str) -> str:
    p = url_path(url)
    trimmed = f"lower({rrep(p, '/+$', chr(39) * 2)})"
    sec = f"{trimmed} IN ({', '.join(q(x) for x in U.SECTION_ROUTE_PATHS)})"
    direct = f"({p} <> '' AND {p} <> '/' AND NOT ends_with({p}, '/') AND NOT ({sec}))"
    return f"(CASE WHEN {direct} THEN 'direct' WHEN {sec} THEN 'section' ELSE 'site' END)"


def is_nav_link(text: str, href: str) -> str:
    return f"({any_(f'lower({text})', U.NAV_KEYWORDS)} OR {any_(f'lower({href})', U.NAV_KEYWORDS)})"


def _unparse(s, n, p, par, qu, f) -> str:
    pp = f"(CASE WHEN {n} <> '' AND {p} <> '' AND NOT starts_with({p}, '/') THEN '/' || {p} ELSE {p} END)"
    return (
        f"((CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END) || (CASE WHEN {n} <> '' THEN '//' || {n} ELSE '' END) || {pp}"
        f" || (CASE WHEN {par} <> '' THEN ';' || {par} ELSE '' END) || (CASE WHEN {qu} <> '' THEN '?' || {qu} ELSE '' END)"
        f" || (CASE WHEN {f} <> '' THEN '#' || {f} ELSE '' END))"
    )


def remove_dot_segments(segs: str) -> str:
    fold = (
        f"list_reduce({segs}, lambda acc, z: CASE WHEN z = '..' THEN acc[1:len(acc)-1] WHEN z = '.' THEN acc "
        "ELSE list_append(acc, z) END, []::VARCHAR[])"
    )
    fold = f"(CASE WHEN ({segs})[-1] IN ('.', '..') THEN list_append({fold}, '') ELSE {fold} END)"
    j = f"array_to_string({fold}, '/')"
    return f"(CASE WHEN {j} = '' THEN '/' ELSE {j} END)"


def url_join(base: str, href: str) -> str:
    bs, bn, bp, bpar, bq = url_scheme(base), url_netloc(base), url_path(base), url_params(base), url_query(base)
    hs = f"(CASE WHEN {url_scheme(href)} = '' THEN {bs} ELSE {url_scheme(href)} END)"
    hn, hp, hpar, hq, hf = url_netloc(href), url_path(href), url_params(href), url_query(href), url_fragment(href)
    bparts = f"string_split({bp}, '/')"
    bdir = f"(CASE WHEN ({bparts})[-1] <> '' THEN ({bparts})[1:len({bparts})-1] ELSE {bparts} END)"
    rel = f"list_concat({bdir}, string_split({hp}, '/'))"
    rel = f"list_filter({rel}, lambda z, i: i = 1 OR i = len({rel}) OR z <> '')"
    segs = f"(CASE WHEN starts_with({hp}, '/') THEN string_split({hp}, '/') ELSE {rel} END)"
    rel_list = ", ".join(q(x) for x in U.USES_RELATIVE)
    return (
        f"(CASE WHEN {base} IS NULL OR {base} = '' THEN {href} WHEN {href} = '' THEN {base} "
        f"WHEN {hs} <> {bs} OR {hs} NOT IN ({rel_list}) THEN {href} "
        f"WHEN {hn} <> '' THEN {_unparse(hs, hn, hp, hpar, hq, hf)} "
        f"WHEN {hp} = '' AND {hpar} = '' THEN {_unparse(hs, bn, bp, bpar, f'(CASE WHEN {hq} <> {chr(39)*2} THEN {hq} ELSE {bq} END)', hf)} "
        f"ELSE {_unparse(hs, bn, remove_dot_segments(segs), hpar, hq, hf)} END)"
    )
