"""Element trees of pages as arrays, one fold over the tags.

A page is cut into tags and the texts between them. One fold with a stack of
open elements says for every tag which element it closes (everything opened
since goes with it), as a lenient parser does: void and self-closed elements
hold nothing, an end tag without an open element is ignored, and what is never
closed ends with its parent or the page. All else follows from that array
without a stack: an element ends at the first later tag that closes it or one
before it. Folds collect their output in short pieces, so that work stays
about linear in the number of tags.

Comments, scripts and styles must be gone before (``remove_noise``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import built_once, decode_entities, py_strip

#: A tag: quoted values may hold ``>``. Possessive, so that long tags are no recursion.
TAG_RE = r"""</?[a-zA-Z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|<[!?][^>]*+>"""
# Elements without content.
VOID = ["area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex",
        "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"]
# Page chrome, removed before title and content.
CHROME = ["nav", "footer", "header", "aside"]
# Main content by element, then by attribute, in order of priority.
MAIN = [("element", "main"), ("element", "article"), ("role", "main"), ("class", "content"), ("class", "main-content"),
        ("class", "post-content"), ("class", "article-content"), ("class", "blog-content"), ("id", "content"), ("id", "main"),
        ("class", "entry-content"), ("class", "post-body")]
# Titles, in order of priority.
TITLES = [("element", "h1"), ("class", "post-title"), ("class", "article-title"), ("class", "entry-title"), ("element", "title")]
BLOCKS = ["div", "section"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_MIN_CHARS = 200

# Stack entries, the innermost first: name, index, texts and breaks before it.
_IN, _END = "\x01", "\x02"
_PIECE = 64  # entries of a piece of a collected array


def _collect(s: dict, entry: Column) -> dict:
    """The state's piece and done with one more entry. It must be a value of
    the step before: ``let`` copies what it returns, so what has been
    collected may not go through one."""
    full = F.size(s["piece"]) >= _PIECE
    return {"piece": F.when(full, F.array(entry)).otherwise(F.array_append(s["piece"], entry)),
            "done": F.when(full, F.array_append(s["done"], s["piece"])).otherwise(s["done"])}


def _collected(s, entry: Column) -> Column:
    """All entries, with a last one."""
    return F.flatten(F.array_append(s["done"], F.array_append(s["piece"], entry)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _find(what: Column, text: Column, start=1) -> Column:
    """Place (from 1) of ``what`` in ``text`` from ``start`` on, 0 if there is none."""
    return F.position(what, text, F.lit(start) if isinstance(start, int) else start)


def _fold(last: Column, first, init: dict, step: Callable[[dict, Column], dict], finish=None) -> Column:
    """Fold over the indexes first..last - 1; the state is a struct of named,
    typed fields. Only plain fields are cast step by step: a cast of a struct
    or array copies all that has been collected in it."""
    names = list(init)
    plain = {n: t for n, (_, t) in init.items() if "<" not in t}
    types = "struct<" + ",".join(f"{n}:{t}" for n, (_, t) in init.items()) + ">"
    start = F.struct(*(F.lit(v).cast(t).alias(n) if not isinstance(v, Column) else v.cast(t).alias(n) for n, (v, t) in init.items()))
    first = first if isinstance(first, Column) else F.lit(first)
    idx = F.when(last > first, F.sequence(first.cast("int"), (last - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def merge(acc, i):
        new = step({n: acc[n] for n in names}, i)
        return F.struct(*((v.cast(plain[n]) if n in plain else v).alias(n) for n, v in ((n, new.get(n, acc[n])) for n in names)))

    return F.aggregate(idx, start, merge, finish) if finish else F.aggregate(idx, start, merge)


def _attribute(tag: Column, name: str) -> Column:
    """The attribute's value, null without it."""
    others = rf"""(?:[\s/]*+(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+)*+"""
    pattern = rf"""(?is)^<[^\s/>]++{others}[\s/]*+{name}\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]*))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)))
    return F.when(F.contains(F.lower(tag), F.lit(name)) & tag.rlike(pattern), value)


def with_tree(df: DataFrame, html: str, p: str) -> DataFrame:
    """Add ``p``-prefixed arrays of the page in column ``html`` (without noise):

    * segs: texts; segs[0] stands before the first tag, segs[i + 1] after tag i
    * plain: the same, character references decoded
    * tags: struct of tag, name, kind (1 start, 0 void, -1 end), and for
      elements class (in spaces), id, role
    * nodes: struct of closes (index of the element that the tag closes, -1 for
      none), single (index of a ``p`` closed there whose only content is one
      text, perhaps inside elements, else -1), texts (how many kept texts stand
      before the one after it), tag_kept and text_kept (the tag, the text after
      it, is not part of the chrome)

    and n, the number of tags, rest_single and rest_texts, as single and texts
    for the end of the page, and singles, the indexes of all such ``p``.
    """
    # one select: each column names those before it, and the plan is checked once
    return df.select("*", *(c for step in _tree_steps(html, p) for c in step)).drop(p + "raw", p + "fold")


@built_once
def _tree_steps(html: str, p: str) -> list[list[Column]]:
    src = F.col(html)
    cut = [F.regexp_extract_all(src, F.lit(TAG_RE), F.lit(0)).alias(p + "raw"), F.split(src, TAG_RE).alias(p + "segs")]
    plain = [F.transform(p + "segs", decode_entities).alias(p + "plain")]

    def described(t):
        name = F.lower(F.regexp_extract(t, r"^</?([^\s/>]+)", 1))
        alone = name.isin(*VOID) | t.startswith("<!") | t.startswith("<?") | (t.endswith("/>") & ~t.rlike(r"""=\s*[^\s"'>]+/>$"""))
        kind = F.when(t.startswith("</"), -1).when(alone, 0).otherwise(1)
        named = F.when(kind >= 0, t)
        spaced = F.concat(F.lit(" "), F.regexp_replace(_attribute(named, "class"), r"\s+", " "), F.lit(" "))
        return F.struct(t.alias("tag"), name.alias("name"), kind.alias("kind"), spaced.alias("class"),
                        _attribute(named, "id").alias("id"), _attribute(named, "role").alias("role"))

    tags = [F.transform(p + "raw", described).alias(p + "tags"), F.size(p + "raw").alias(p + "n")]
    tag = lambda i: F.get(p + "tags", i)
    node = "struct<closes:int,single:int,texts:int,tag_kept:boolean,text_kept:boolean>"

    def single_in(stack: Column, texts: Column, breaks: Column) -> Column:
        """Index of the innermost p of these entries if it holds one text and nothing beside it, else -1."""
        at = _find(F.lit(_END + "p" + _IN), F.concat(F.lit(_END), stack))
        parts = F.split(F.substring_index(F.substr(stack, at), _END, 1), _IN)
        held = (texts - F.get(parts, F.lit(2)).cast("int") == 1) & (breaks - F.get(parts, F.lit(3)).cast("int") == 0)
        return F.when((at > 0) & held, F.get(parts, F.lit(1)).cast("int")).otherwise(-1)

    def step(s, i):
        return {"now": let(tag(i), lambda t: _read(s["now"], t, i)), **_collect(s, s["now"]["row"])}

    def _read(s, t, i):
        name, kind, stack = t["name"], t["kind"], s["stack"]
        at = F.when(kind == -1, _find(F.concat(F.lit(_END), name, F.lit(_IN)), F.concat(F.lit(_END), stack))).otherwise(0)
        outside = s["chrome"] < 0
        after = F.length(F.get(p + "segs", i + 1)) > 0

        def with_entry(x):
            closing = x["at"] > 0
            end = _find(F.lit(_END), stack, x["at"])
            gone = F.when(closing, F.substr(stack, F.lit(1), end))
            closes = F.when(closing, F.get(F.split(F.substr(stack, x["at"], end - x["at"]), _IN), F.lit(1)).cast("int")).otherwise(-1)
            # texts and breaks are counted outside the chrome; a p is a chain while there are none
            broken = outside & ~name.isin(*CHROME) & ((kind == 0) | ((kind == 1) & ~s["opened"]))
            return let(F.struct(gone.alias("gone"), closes.alias("closes"), (s["breaks"] + broken.cast("int")).alias("breaks"), end.alias("end")),
                       lambda y: moved(x, y))

        def moved(x, y):
            closing = x["at"] > 0
            opens = (kind == 1)
            chrome = (F.when(outside & opens & name.isin(*CHROME), i).when(~outside & closing & (y["closes"] <= s["chrome"]), F.lit(-1))
                      .otherwise(s["chrome"]))
            entry = F.concat(name, F.lit(_IN), i.cast("string"), F.lit(_IN), s["texts"].cast("string"), F.lit(_IN), y["breaks"].cast("string"), F.lit(_END))
            new = F.when(opens, F.concat(entry, stack)).when(closing, F.substr(stack, y["end"] + 1)).otherwise(stack)
            single = F.when(closing & F.contains(F.concat(F.lit(_END), y["gone"]), F.lit(_END + "p" + _IN)), single_in(y["gone"], s["texts"], y["breaks"])).otherwise(-1)
            return let(chrome, lambda c: recorded(y, new, single, c))

        def recorded(y, new, single, c):
            tag_kept = (c < 0) & (outside | (y["closes"] != s["chrome"])) & ~((kind == 0) & name.isin(*CHROME))
            text_kept = c < 0
            row = F.struct(y["closes"].alias("closes"), single.alias("single"), s["texts"].alias("texts"), tag_kept.alias("tag_kept"), text_kept.alias("text_kept")).cast(node)
            text = text_kept & after
            # a text that does not follow its element's start tag stands beside something
            opened = F.when(tag_kept, kind == 1).otherwise(s["opened"])
            beside = text & ~opened
            return F.struct(
                new.alias("stack"), c.cast("int").alias("chrome"), (s["texts"] + text.cast("int")).alias("texts"),
                (y["breaks"] + beside.cast("int")).alias("breaks"), (opened & ~text).alias("opened"), row.alias("row"),
            )

        return let(F.struct(at.alias("at")), with_entry)

    state = f"struct<stack:string,chrome:int,texts:int,breaks:int,opened:boolean,row:{node}>"
    start = F.struct(F.lit("").alias("stack"), F.lit(-1).alias("chrome"), F.lit(0).alias("texts"), F.lit(0).alias("breaks"),
                     F.lit(True).alias("opened"), F.lit(None).cast(node).alias("row"))
    init = {"now": (start, state), "piece": (F.array(), f"array<{node}>"), "done": (F.array(), f"array<array<{node}>>")}
    # the first entry is that of the start
    folded = _fold(F.col(p + "n"), 0, init, step,
                   lambda s: F.struct(F.slice(_collected(s, s["now"]["row"]), F.lit(2), F.col(p + "n")).alias("nodes"),
                                      single_in(s["now"]["stack"], s["now"]["texts"], s["now"]["breaks"]).alias("rest"),
                                      s["now"]["texts"].alias("texts")))
    nodes, rest = F.col(p + "fold.nodes"), F.col(p + "fold.rest")
    singles = F.filter(F.concat(F.transform(nodes, lambda x: x["single"]), F.array(rest)), lambda x: x >= 0)
    unfolded = [nodes.alias(p + "nodes"), rest.alias(p + "rest_single"), F.col(p + "fold.texts").alias(p + "rest_texts"), singles.alias(p + "singles")]
    return [cut, plain, tags, [folded.alias(p + "fold")], unfolded]


def _end_of(p: str, m: Column) -> Column:
    """Index of the tag that ends element ``m`` (n if none does); m + 1 for a void one."""
    later = F.when(F.col(p + "n") > m + 1, F.sequence(m + 1, F.col(p + "n") - 1)).otherwise(F.array().cast("array<int>"))
    closing = F.filter(later, lambda j: F.get(p + "nodes", j)["closes"].between(0, m))
    return F.when(F.get(p + "tags", m)["kind"] == 0, m).otherwise(F.coalesce(F.get(closing, F.lit(0)), F.col(p + "n")))


def first_of(p: str, selectors: Sequence[tuple[str, str]]) -> Column:
    """Struct of rank and at: the first element of the first selector that any element outside the chrome meets; null if none."""
    def rank(t):
        out = F.lit(None).cast("int")
        for k, (what, value) in reversed(list(enumerate(selectors))):
            test = {"element": lambda: t["name"] == value, "class": lambda: F.contains(t["class"], F.lit(f" {value} ")),
                    "id": lambda: t["id"] == value, "role": lambda: t["role"] == value}[what]()
            out = F.when(test, k).otherwise(out)
        return out

    met = F.transform(p + "tags", lambda t, i: F.when((t["kind"] >= 0) & F.get(p + "nodes", i)["tag_kept"], F.struct(rank(t).alias("rank"), i.alias("at"))))
    return F.array_min(F.filter(met, lambda x: x["rank"].isNotNull()))


def first_text(p: str, selectors: Sequence[tuple[str, str]]) -> Column:
    """Stripped text of the first selector's first element that has some; null if none has."""
    wanted = F.array(*(F.struct(F.lit(w).alias("what"), F.lit(v).alias("value")) for w, v in selectors))

    def text(sel):
        def meets(i):
            t = F.get(p + "tags", i)
            at = F.when(sel["what"] == "element", t["name"] == sel["value"]).otherwise(
                F.contains(t["class"], F.concat(F.lit(" "), sel["value"], F.lit(" "))))
            return at & (t["kind"] >= 0) & F.get(p + "nodes", i)["tag_kept"]

        return let(F.get(F.filter(_range(F.lit(0), F.col(p + "n")), meets), F.lit(0)), lambda m: F.when(m.isNotNull(), py_strip(outer_text(p, m))))

    return F.get(F.filter(F.transform(wanted, text), lambda x: x.isNotNull() & (x != "")), F.lit(0))


def _kept_text(p: str, i: Column, texts: str = "segs") -> Column:
    return F.when((i < 0) | F.get(p + "nodes", i)["text_kept"], F.get(p + texts, i + 1)).otherwise("")


def _range(first: Column, end: Column) -> Column:
    return F.when(end > first, F.sequence(first.cast("int"), (end - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def outer_text(p: str, m: Column) -> Column:
    """Text of element ``m``."""
    return let(_end_of(p, m), lambda e: F.array_join(F.transform(_range(m, e), lambda i: _kept_text(p, i, "plain")), ""))


def inner_html(p: str, m: Column) -> Column:
    """Markup and text inside element ``m``, without chrome; of the whole page for -1."""
    def piece(i):
        own = F.when((i > m) & F.get(p + "nodes", i)["tag_kept"], F.get(p + "tags", i)["tag"]).otherwise("")
        return F.concat(own, _kept_text(p, i))

    end = F.when(m < 0, F.col(p + "n")).otherwise(_end_of(p, m))
    return let(end, lambda e: F.array_join(F.transform(_range(m, e), piece), ""))


def largest_block(p: str, lens: Column) -> Column:
    """Index of the outermost div or section outside the chrome with the
    longest text (the first of them) if that has over 200 characters, else
    null. ``lens`` holds the lengths of the segments' texts, a parent's text
    holds its children's."""
    node = lambda i: F.get(p + "nodes", i)

    def step(s, i):
        t, n = F.get(p + "tags", i), node(i)
        closes = (s["start"] >= 0) & n["closes"].between(0, s["start"])
        opens = (s["start"] < 0) & (t["kind"] == 1) & n["tag_kept"] & t["name"].isin(*BLOCKS)
        better = closes & (s["size"] > s["best"])
        here = F.get(lens, i + 1) * n["text_kept"].cast("int")
        return {
            "start": F.when(closes, F.lit(-1)).when(opens, i).otherwise(s["start"]),
            "size": F.when(opens, here).when(closes, F.lit(0)).otherwise(s["size"] + F.when(s["start"] >= 0, here).otherwise(0)),
            "best": F.when(better, s["size"]).otherwise(s["best"]), "first": F.when(better, s["start"]).otherwise(s["first"]),
        }

    def finish(s):
        open_wins = (s["start"] >= 0) & (s["size"] > s["best"])
        return F.when(F.greatest(s["best"], F.when(open_wins, s["size"])) > BLOCK_MIN_CHARS, F.when(open_wins, s["start"]).otherwise(s["first"]))

    init = {"start": (-1, "int"), "size": (0, "int"), "best": (-1, "int"), "first": (-1, "int")}
    return _fold(F.col(p + "n"), 0, init, step, finish)


_CONTEXT = ("heading", "single", "list", "item", "link", "code")


def _contexts(p: str, m: str, end: str) -> Column:
    """Per tag from ``m`` to before ``end``, for the text after it: which
    heading, single-text p, outer list, outer item of it, link and code it
    stands in (-1: none), and how many items have begun. What stands in a
    heading or single-text p, or links and code in lists, is plain text."""
    row = "struct<" + ",".join(f"{c}:int" for c in (*_CONTEXT, "items")) + ">"
    none = F.struct(*(F.lit(-1).alias(c) for c in _CONTEXT), F.lit(0).alias("items")).cast(row)

    def step(s, i):
        t, n, old = F.get(p + "tags", i), F.get(p + "nodes", i), s["now"]
        name = t["name"]

        def entered(c):
            starts = (t["kind"] == 1) & n["tag_kept"]
            free = starts & (c["heading"] < 0) & (c["single"] < 0)
            plain, item = free & (c["list"] < 0), free & (c["list"] >= 0) & (name == "li")
            begins = {
                "heading": starts & (c["heading"] < 0) & name.isin(*HEADINGS),
                "single": free & (name == "p") & F.array_contains(p + "singles", i),
                "list": plain & name.isin("ul", "ol"),
                "item": item & (c["item"] < 0),
                "link": plain & (c["link"] < 0) & (name == "a") & (F.coalesce(_attribute(t["tag"], "href"), F.lit("")) != ""),
                "code": plain & (c["link"] < 0) & (c["code"] < 0) & name.isin("code", "pre"),
            }
            new = F.struct(*(F.when(begins[x], i).otherwise(c[x]).alias(x) for x in _CONTEXT), (old["items"] + item.cast("int")).alias("items"))
            return new.cast(row)

        left = F.struct(*(F.when((old[x] >= 0) & n["closes"].between(0, old[x]), -1).otherwise(old[x]).alias(x) for x in _CONTEXT))
        return {"now": let(left, entered), **_collect(s, old)}

    init = {"now": (none, row), "piece": (F.array(), f"array<{row}>"), "done": (F.array(), f"array<array<{row}>>")}
    return _fold(F.col(end), F.col(m) + 1, init, step, lambda s: _collected(s, s["now"]))


def with_markdown(df: DataFrame, p: str, m: str, out: str) -> DataFrame:
    """Add ``out``: element number ``m`` of the tree ``p`` as markdown, null without it.

    Headings are ``#`` marks and their text; a ``p`` whose only content is one
    text (perhaps inside elements) ends with a blank line; of a list stand its
    items' texts, ``- `` each, items of inner lists again after the item that
    holds them; links are ``[text](href)`` and code is in back ticks where they
    stand outside headings, such paragraphs and lists, the outer of two nested
    ones only. Everything else is its text.
    """
    df = df.select("*", *_markdown_steps(p, m, out))
    return df.drop(*(f"{p}md_{x}" for x in ("end", "ctx", "marks", "bare")))


@built_once
def _markdown_steps(p: str, m: str, out: str) -> list[Column]:
    c = {x: f"{p}md_{x}" for x in ("end", "ctx", "marks", "bare")}
    start, end = F.col(m), F.col(c["end"])
    node, tag = (lambda i: F.get(p + "nodes", i)), (lambda i: F.get(p + "tags", i))
    ctx = lambda i: F.get(c["ctx"], i - start)
    texts = lambda i: F.when(i < F.col(p + "n"), node(i)["texts"]).otherwise(F.col(p + "rest_texts"))

    def mark(i):
        """closing: what ends at tag i; own: what begins there, and the text after it."""
        return let(F.struct(ctx(i - 1).alias("was"), ctx(i).alias("now")), lambda x: marked(i, x["was"], x["now"]))

    def left(was, now, x):
        return F.coalesce((was[x] >= 0) & (F.coalesce(now[x], F.lit(-1)) != was[x]), F.lit(False))

    def marked(i, was, now):
        blank = left(was, now, "single")
        within = blank & (was["single"] > F.greatest(was["link"], was["code"]))
        href = decode_entities(_attribute(tag(was["link"])["tag"], "href"))
        closing = F.concat(
            F.when(within, F.lit("\n\n")).otherwise(""),
            F.when(left(was, now, "link") & (texts(i) > node(was["link"])["texts"]), F.concat(F.lit("]("), href, F.lit(")"))).otherwise(""),
            F.when(left(was, now, "code"), F.lit("`")).otherwise(""),
            F.when(left(was, now, "heading"), F.lit("\n\n")).otherwise(""),
            F.when(blank & ~within, F.lit("\n\n")).otherwise(""),
        )
        text = F.when((i < end) & node(i)["text_kept"], F.get(p + "plain", i + 1)).otherwise("")
        own = F.concat(
            F.when(now["heading"] == i, F.concat(F.repeat(F.lit("#"), F.substr(tag(i)["name"], F.lit(2)).cast("int")), F.lit(" "))).otherwise(""),
            F.when(now["code"] == i, F.lit("`")).otherwise(""),
            F.when((now["link"] >= 0) & (F.get(p + "segs", i + 1) != "") & (i < end) & node(i)["text_kept"] & (node(i)["texts"] == node(now["link"])["texts"]), F.lit("[")).otherwise(""),
            text,
        )
        return F.struct(closing.alias("closing"), own.alias("own"))

    marks = lambda i: F.get(c["marks"], i - start)
    # lists that ended without an item keep their text
    empty = F.filter(_range(start + 1, end + 1), lambda i: left(ctx(i - 1), ctx(i), "list") & (ctx(i - 1)["items"] == ctx(ctx(i - 1)["list"])["items"]))
    loose = lambda x: (x["list"] >= 0) & (x["item"] < 0) & ~F.array_contains(c["bare"], x["list"])

    def inner_items(item, i):
        """Lines of the items inside the outer item that ends at tag i."""
        def begins(k):
            return (tag(k)["name"] == "li") & (tag(k)["kind"] == 1) & node(k)["tag_kept"] & (ctx(k)["heading"] < 0) & (ctx(k)["single"] < 0)

        def line(k):
            ends = F.coalesce(F.get(F.filter(_range(k + 1, i), lambda j: node(j)["closes"].between(0, k)), F.lit(0)), i)
            body = lambda e: F.array_join(F.transform(_range(k, e), lambda x: F.concat(F.when(x > k, marks(x)["closing"]).otherwise(""), marks(x)["own"])), "")
            return let(ends, lambda e: F.concat(F.lit("- "), body(e), marks(e)["closing"], F.lit("\n")))

        return F.array_join(F.transform(F.filter(_range(item + 1, i), begins), line), "")

    def written(i):
        was, now = ctx(i - 1), ctx(i)
        return F.concat(
            F.when(F.coalesce(loose(was), F.lit(False)), F.lit("")).otherwise(marks(i)["closing"]),
            F.when(left(was, now, "item"), F.concat(F.lit("\n"), inner_items(was["item"], i))).otherwise(""),
            F.when(left(was, now, "list") & ~F.array_contains(c["bare"], was["list"]), F.lit("\n")).otherwise(""),
            F.when(now["item"] == i, F.lit("- ")).otherwise(""),
            F.when(F.coalesce(loose(now), F.lit(False)), F.lit("")).otherwise(marks(i)["own"]),
        )

    text = F.array_join(F.transform(_range(start, end + 1), written), "")
    return [
        _end_of(p, start).alias(c["end"]),
        F.when(start.isNotNull(), _contexts(p, m, c["end"])).alias(c["ctx"]),
        F.transform(_range(start, end + 1), mark).alias(c["marks"]),
        F.transform(empty, lambda i: ctx(i - 1)["list"]).alias(c["bare"]),
        F.when(start.isNotNull(), text).alias(out),
    ]
