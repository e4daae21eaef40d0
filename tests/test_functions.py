"""Literal fixtures for the column functions, checked against Python semantics."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitesift.functions import classify as CL
from sitesift.functions import urls as U
from sitesift.functions.chunk import chunk_content
from sitesift.functions.text import py_split, py_strip

BASES = ["https://h.example/a/b/c", "https://h.example/a/b/", "http://h.example", "https://h.example/x?q=1#f"]
HREFS = ["", "g", "./g", "g/", "/g", "//g.example/x", "?y", "#s", "g?y#s", "..", "../", "../g", "../..",
         "../../../g", "./", ".", "mailto:a@b", "https://o.example/p/../q", "g;x=1", "/./a/../b", "a//b/../c"]


def test_url_join_matches_urllib(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string")
    got = df.select("b", "h", U.url_join("b", "h").alias("j")).collect()
    bad = [(r.b, r.h, r.j, urljoin(r.b, r.h)) for r in got if r.j != urljoin(r.b, r.h)]
    assert not bad, bad


CONTENT = [
    ("https://s.example/blog/a", True), ("https://s.example/blog/about-x", False),
    ("https://s.example/democracy/essay/", False), ("https://s.example/2024/05/", True),
    ("https://s.example/2024", False), ("https://s.example/x", False), ("https://s.example/a/b", True),
    ("https://s.example/products/item/1", False), ("https://s.example/data/x.json", False),
    ("https://www.s.example/blog/a", False), ("https://s.example:8080/blog/a", False),
    ("https://s.example/Blog/Post", True),
]


def test_content_url_fixture(spark):
    df = spark.createDataFrame(CONTENT, "u string, want boolean")
    got = df.select("u", "want", U.is_content_url("u", F.lit("s.example")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_section_and_rendered(spark):
    rows = [
        ("https://s.example/blog/x", "https://s.example/blog", True),
        ("https://s.example/blogging/x", "https://s.example/blog", True),
        ("https://s.example/blog", "https://s.example/blog", False),
        ("https://s.example/api/blog/", "https://s.example/blog", False),
        ("https://s.example/x", "https://s.example/", True),
        ("https://s.example/how-to", "https://s.example/blog", True),
    ]
    df = spark.createDataFrame(rows, "u string, s string, want boolean")
    got = df.select(U.is_section_content_url("u", "s", F.lit("s.example")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]
    rr = [("https://x.substack.com/p/t", True), ("https://x.substack.com/p/t/comments", False),
          ("https://x.substack.com/t/tag", False), ("https://a.example/products/a", True)]
    df2 = spark.createDataFrame(rr, "u string, want boolean")
    got2 = df2.select(U.is_rendered_content_url("u").alias("g"), "want").collect()
    assert [r.g for r in got2] == [r.want for r in got2]


def test_route(spark):
    rows = [("https://s.example", "site"), ("https://s.example/", "site"), ("https://s.example/blog", "section"),
            ("https://s.example/blog/", "section"), ("https://s.example/BLOG", "section"),
            ("https://s.example/foo/", "site"), ("https://s.example/blog/post", "direct"), ("https://s.example/foo", "direct")]
    df = spark.createDataFrame(rows, "u string, want string")
    got = df.select(U.route("u").alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_python_whitespace(spark):
    texts = ["  a b\t c\n", "　x y ", "", "   ", "\x0bz\x1c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(py_strip("t").alias("s"), py_split("t").alias("w")).collect()
    assert [r.s for r in got] == [t.strip() for t in texts]
    assert [list(r.w) for r in got] == [t.split() for t in texts]


def _py_chunks(content, m):
    chunks, cur, n = [], [], 0
    for p in content.split("\n\n"):
        if n + len(p) > m and cur:
            chunks.append("\n\n".join(cur))
            cur, n = [p], len(p)
        else:
            cur.append(p)
            n += len(p) + 2
    if cur:
        chunks.append("\n\n".join(cur))
    return chunks or [content]


def test_chunk_fold_matches_python(spark):
    paras = ["x" * n for n in (10, 990, 5, 700, 300, 1200, 1, 1, 998, 2000)]
    texts = ["\n\n".join(paras[:k]) for k in range(1, len(paras) + 1)] + ["", "single"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for m in (50, 1000, 1002):
        got = df.select("t", chunk_content("t", m).alias("c")).collect()
        for r in got:
            assert list(r.c) == _py_chunks(r.t, m)
            assert "\n\n".join(r.c) == r.t


def test_markdown_title(spark):
    texts = ["# Hello\nx", "intro\n   #  \n  # Real Title  ", "no heading", "#nospace\n# ok", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.g for r in df.select(CL.title_from_markdown("t").alias("g")).collect()]

    def py(c):
        for line in c.split("\n"):
            line = line.strip()
            if line.startswith("# "):
                return line[2:].strip()
        return "Untitled"

    assert got == [py(t) for t in texts]


def test_classifier_rules(spark):
    rows = [
        ("https://a.substack.com/x", "podcast", "", "blog"),
        ("https://www.linkedin.com/x", "", "", "linkedin_post"),
        ("https://reddit.com/r", "", "", "reddit_comment"),
        ("https://a.example/x", "Technically speaking", "", "call_transcript"),
        ("https://a.example/x", "facebook notes", "", "book"),
        ("https://a.example/x", "the transcript", "", "podcast_transcript"),
        ("https://a.example/news/x", "", "", "news"),
        ("https://a.example/x", "t", " ".join(["w"] * 101) + " how to guide: ", "tutorial"),
        ("https://a.example/x", "t", " ".join(["w"] * 97) + " how to guide:", "blog"),
        ("https://a.example/x", "t", "1. a 2. b 3. c " + " ".join(["w"] * 101), "tutorial"),
    ]
    df = spark.createDataFrame(rows, "u string, t string, c string, want string")
    got = df.select(CL.classify("u", "t", "c").alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_character_references_as_the_standard_library(spark):
    import html
    import html.entities
    import random

    from sitesift.functions.text import decode_entities

    rng, names = random.Random(1), list(html.entities.html5)
    texts = ["&copy &copy; &notit; &notin; &not it", "&#0;&#128;&#x9f;&#129;&#xD800;&#1114112;&#99999999999999999999;&#x0000041;&#1;&#11;&#xFFFE;&#127;",
             "&amp;lt; &unknown; &&amp &;&# &#x;&#65 &#x41 &Aacute &aacutex &AMP", "&" + "a" * 40 + ";", "&frac12x;&frac1;", "a&lt<b", " &#xZZ; &é;"]
    texts += ["".join(rng.choice([f"&{rng.choice(names)}", f"&{rng.choice(names)[:-1]}x", f"&#{rng.randrange(1300)};", f"&#x{rng.randrange(70000):x}", " y"])
                      for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("x", decode_entities("x").alias("d"))
    assert all(r.d == html.unescape(r.x) for r in df.collect())


def test_url_join_matches_each_url_once_and_agrees_with_urljoin(spark):
    from urllib.parse import urljoin

    from sitesift.functions.urls import url_join

    bases = ["http://h/a/b;p=1?q#f", "https://h", "http://h/a//b/../c/", "/x/y", "mailto:a@b", "http://h/;p", "", None]
    hrefs = ["", "p", "../..//p;v", "./", "?q", ";v", "#f", "//o/x", "a//b/./c/..", "..", "ftp:z", "/r/./s/../t", None]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").select("b", "h", url_join("b", "h").alias("u"))
    for r in df.collect():
        if r.b is None or r.h is None:
            assert r.u == (r.h if r.b is None else None)
        else:
            assert r.u == urljoin(r.b, r.h), (r.b, r.h)
    # values used several times are bound: written out, the patterns stood in the plan far over a hundred times
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 14
