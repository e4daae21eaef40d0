"""Element trees and markdown against a tree built tag by tag in Python."""

import random
import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from sitesift.functions import tree as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def all(self, *names):
        out = []
        for c in self.children:
            if not isinstance(c, str):
                out += ([c] if c.name in names else []) + c.all(*names)
        return out

    def string(self):
        if len(self.children) != 1:
            return None
        return self.children[0] if isinstance(self.children[0], str) else self.children[0].string()

    def replace(self, text):
        self.children = [text]


def tree_of(tokens):
    """tokens: ('start'|'void'|'end', name, attrs) or texts."""
    top = at = Node("", {}, None)
    for t in tokens:
        if isinstance(t, str):
            if t:
                at.children.append(t)
            continue
        kind, name, attrs = t
        if kind == "end":
            up = at
            while up is not None and up.name != name:
                up = up.parent
            if up is not None and up is not top:
                at = up.parent
            continue
        node = Node(name, attrs, at)
        at.children.append(node)
        if kind == "start":
            at = node
    return top


def drop_chrome(node):
    node.children = [c for c in node.children if isinstance(c, str) or c.name not in T.CHROME]
    for c in node.children:
        if not isinstance(c, str):
            drop_chrome(c)


def markdown_of(element):
    """Replacements in the order headings, paragraphs, lists, links, code."""
    for i in range(1, 7):
        for h in element.all(f"h{i}"):
            h.replace("#" * i + " " + h.text() + "\n\n")
    for p in element.all("p"):
        if p.string():
            p.replace(p.text() + "\n\n")
    for u in element.all("ul", "ol"):
        lines = "".join(f"- {li.text()}\n" for li in u.all("li"))
        if lines:
            u.replace(lines + "\n")
    for a in element.all("a"):
        if a.attrs.get("href") and a.text():
            a.replace(f"[{a.text()}]({a.attrs['href']})")
    for c in element.all("code", "pre"):
        c.replace("`" + c.text() + "`")
    return element.text()


def html_of(tokens, rng):
    out = []
    for t in tokens:
        if isinstance(t, str):
            out.append(t)
        else:
            kind, name, attrs = t
            name = rng.choice([name, name.upper()])
            quoted = "".join(f" {k}={q}{v}{q}" for k, v in attrs.items() for q in [rng.choice("\"'")])
            out.append(f"</{name} >" if kind == "end" else f"<{name}{quoted}{rng.choice(['', ' ']) if kind == 'start' else rng.choice(['', '/'])}>")
    return "".join(out)


PARENTS = {"ul": ["li"], "ol": ["li"]}
INNER = ["p", "b", "a", "h2", "h3", "ul", "ol", "code", "pre", "div", "section", "nav", "span", "br", "img", "footer"]


MARKED = {"a", "p", "code", "pre", "h2", "h3"}


def well_formed(rng, depth, parent="", marked=False):
    """Nested tokens; texts now and then empty, white or with references. Of
    what markdown marks, lists apart, nothing stands inside another."""
    out = []
    for _ in range(rng.randint(0, 4)):
        out.append(rng.choice(["", "", "x", " ", "t &amp; u", "y z", "&#65;"]))
        if depth:
            allowed = PARENTS.get(parent, [x for x in INNER if not (marked and x in MARKED | {"ul", "ol"})])
            name = rng.choice(allowed)
            attrs = {"href": "/u?a=1&amp;b=2"} if name == "a" and rng.random() < 0.8 else {}
            if name in VOID:
                out.append(("void", name, attrs))
            else:
                out += [("start", name, attrs), *well_formed(rng, depth - 1, name, marked or name in MARKED), ("end", name, {})]
    out.append(rng.choice(["", "end"]))
    return out


def decoded(tokens):
    return [unescape(t) if isinstance(t, str) else (t[0], t[1], {k: unescape(v) for k, v in t[2].items()}) for t in tokens]


def merged(tokens):
    """Texts side by side are one text."""
    out = []
    for t in tokens:
        if isinstance(t, str) and out and isinstance(out[-1], str):
            out[-1] += t
        else:
            out.append(t)
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    rows = []
    for i in range(400):
        tokens = merged([("start", "div", {"class": "other"}), *well_formed(rng, 3), ("end", "div", {}),
                         ("start", "article", {}), *well_formed(rng, 4), ("end", "article", {}), *well_formed(rng, 2)])
        if i % 2:  # without some end tags
            tokens = merged([t for t in tokens if isinstance(t, str) or t[0] != "end" or t[1] in ("article", "ul", "ol") or rng.random() < 0.9])
        rows.append((i, tokens, html_of(tokens, rng)))
    return rows


def trees(spark, rows):
    df = spark.createDataFrame([(r[0], r[-1]) for r in rows], "i int, html string").repartition(4)
    return T.with_tree(df, "html", "t_")


def test_main_text_markdown_and_blocks(spark, pages):
    df = trees(spark, pages).select("*", T.first_of("t_", T.MAIN)["at"].alias("m"), F.transform("t_segs", lambda x: F.length(x)).alias("t_lens"))
    df = T.with_markdown(df, "t_", "m", "md").select("i", "md", T.outer_text("t_", F.col("m")).alias("text"), T.inner_html("t_", F.lit(-1)).alias("rest"))
    got = {r.i: r for r in df.collect()}
    for i, tokens, html in pages:
        top = tree_of(decoded(tokens))
        drop_chrome(top)
        articles = top.all("article")
        if not articles:
            assert got[i].md is None
            continue
        assert got[i].text == articles[0].text(), html
        plain = top.text()
        assert unescape(re.sub(r"<[^>]*>", "", got[i].rest)) == plain, html
        if i % 2 == 0:  # nested as the rules for markdown take them
            assert got[i].md == markdown_of(articles[0]), html


PROBES = [
    ("<nav>a<nav>b</nav>c</nav>d", "d"),
    ("<nav>a</div>b</nav>c", "c"),
    ("<div><footer>x</div>y", "<div></div>y"),
    ("<header>never closed <p>x</p>", ""),
    ("a<br/>b<nav/>c", "a<br/>bc"),
]


def test_chrome(spark):
    df = T.with_tree(spark.createDataFrame([(i, h, "") for i, (h, _) in enumerate(PROBES)], "i int, html string, x string"), "html", "t_")
    got = {r.i: r.rest for r in df.select("i", T.inner_html("t_", F.lit(-1)).alias("rest")).collect()}
    assert [got[i] for i in range(len(PROBES))] == [want for _, want in PROBES]


MARKDOWN = [
    ("<article><p><b>x</b></p><ul><li>a</li></ul></article>", "x\n\n- a\n\n"),
    ("<article><h2>A <a href='/u'>l</a></h2>t <a href='/u'>l</a></article>", "## A l\n\nt [l](/u)"),
    ("<article><ul><li>a<ul><li>b</li></ul></li> <li><code>c</code></li></ul></article>", "- ab\n- b\n- c\n\n"),
    ("<article><p>a<br>b</p><pre><code>x</code></pre><p><a href=/u/>only</a></p>", "ab`x`only\n\n"),
    ("<article><ul>loose</ul><a href=''>n</a><a href='/e'></a><a>m</a></article>", "loosenm"),
    ("<article><p>one<p>two</article>three", "onetwo\n\n"),
    ("<input class=\"content\"><p>a</p><div>rest</div>", ""),
    ("<main>m</main><article>a</article>", "m"),
    ("<div id='main'>i</div><div class='x content y'>c</div>", "c"),
    ("<div class='contents'>no</div>", None),
    ("<a title='1 > 0' href=\"/q\">no main</a>", None),
    ("<article><a title='1 > 0' href=\"/q?x=1&amp;y\">q</a></article>", "[q](/q?x=1&y)"),
]


def test_markdown_probes(spark):
    df = T.with_tree(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKDOWN)], "i int, html string"), "html", "t_")
    df = T.with_markdown(df.select("*", T.first_of("t_", T.MAIN)["at"].alias("m")), "t_", "m", "md")
    got = {r.i: r.md for r in df.select("i", "md").collect()}
    assert [got[i] for i in range(len(MARKDOWN))] == [want for _, want in MARKDOWN]


def test_work_is_about_linear(spark):
    """Many blocks, nested and not, closed and not."""
    seconds = []
    for n in (1000, 4000):
        rows = [(0, "<div>a" * n + "</div>" * n), (1, "<p>unclosed <b>x</b>" * n), (2, "<ul>" + "<li>i</li>" * n + "</ul>")]
        df = T.with_tree(spark.createDataFrame([(i, "<main>" + h + "</main>") for i, h in rows], "i int, html string"), "html", "t_")
        df = T.with_markdown(df.select("*", T.first_of("t_", T.MAIN)["at"].alias("m")), "t_", "m", "md")
        df = df.select("i", "md")
        t0 = time.time()
        got = {r.i: r.md for r in df.collect()}
        seconds.append(time.time() - t0)
        assert got[0] == "a" * n and got[2] == "- i\n" * n + "\n"
    assert seconds[1] < 12 * seconds[0] + 3, seconds


def test_folds_collect_in_pieces_and_do_not_copy_what_they_collected(spark):
    for n in (0, 1, T._PIECE - 1, T._PIECE, T._PIECE + 1, 2 * T._PIECE, 2 * T._PIECE + 1, 5 * T._PIECE):
        df = spark.createDataFrame([("<p>a</p>" * (n // 2) + "<b>" * (n % 2),)], "html string")
        df = T.with_tree(df, "html", "q_")
        row = df.select(F.col("q_n"), F.transform("q_nodes", lambda x: x["closes"]).alias("closes"), "q_singles").first()
        assert row.q_n == n
        assert row.closes == [i - 1 if i % 2 else -1 for i in range(n)]
        assert row.q_singles == list(range(0, n - n % 2, 2))
    # the state as a whole was cast at every tag
    assert "as struct<state" not in df._jdf.queryExecution().analyzed().toString()
