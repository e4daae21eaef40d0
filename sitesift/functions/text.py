"""Text helpers as Spark Column expressions.

Everything here is built-in JVM expressions; no Python runs per row.
"""

from __future__ import annotations

from functools import wraps
from html.entities import html5

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as white space,
# derived by rule (str.isspace) rather than typed out.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# The same set as a regex character class understood by both Java regex
# and RE2 (so oracle SQL can share it).
PY_WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Character references: decimal, hexadecimal, or a name, with or without its semicolon.
ENTITY_RE = r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([^\t\n\f <&#;]{1,32})(;?))"
# Names come from the standard library's table of HTML 5: those that end with
# a semicolon as one text of names and values (a plain literal, as planning
# compares literals often), the old ones that need none as a pattern, the
# longest first.
_NAME, _VALUE = "\x01", "\x02"
ENTITY_NAMES = "".join(f"{_NAME}{k[:-1]}{_VALUE}{v}" for k, v in html5.items() if k.endswith(";")) + _NAME
ENTITY_OLD_RE = "^(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"
#: The code points 128 to 159 mean characters of Windows 1252, where it has one.
ENTITY_1252 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))


_BUILT: dict = {}


def built_once(function):
    """Keep what ``function`` builds of its names: large expressions take
    thousands of calls into the JVM, and columns can be used again."""
    @wraps(function)
    def build(*names):
        key = (SparkSession.active().sparkContext.applicationId, function.__module__, function.__name__, names)
        if key not in _BUILT:
            _BUILT[key] = function(*names)
        return _BUILT[key]

    return build


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trim the Unicode white-space set on both ends."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def py_split(c) -> Column:
    """Python ``str.split()`` (no argument): runs of white space, no empty items."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, PY_WS_CLASS + "+"))


def collapse_ws(c) -> Column:
    """``' '.join(s.split())``."""
    return F.regexp_replace(py_strip(c), PY_WS_CLASS + "+", " ")


def ellipsis(c, n: int) -> Column:
    """``s[:n] + '...' if len(s) > n else s`` (NULL stays NULL)."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def _reference(entity: Column, table: Column) -> Column:
    """What one reference stands for, as Python's ``html.unescape``: unknown
    names stay as they are but for a known beginning that needs no semicolon;
    numbers of no character give U+FFFD, of control characters nothing."""
    dec, hexa, name, end = (F.regexp_extract(entity, ENTITY_RE, g) for g in (1, 2, 3, 4))
    digits = F.ltrim(F.concat(dec, hexa), F.lit("0"))
    big = F.length(digits) > 8
    code = F.when(big, F.lit(1 << 40)).when(dec != "", F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).cast("long")).when(
        hexa != "", F.conv(F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")), 16, 10).cast("long"))
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(1 << 16)) >= 0xFFFE)
    char = (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(chr(0xFFFD)))
        .when(code.between(128, 159), F.substr(F.lit(ENTITY_1252), (code - 127).cast("int"), F.lit(1)))
        .when(control, F.lit(""))
        .when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )

    def named(n: Column) -> Column:
        at = F.position(F.concat(F.lit(_NAME), n, F.lit(_VALUE)), table)
        value = F.substring_index(F.substr(table, at + F.length(n) + 2, F.lit(4)), _NAME, 1)
        return F.when(at > 0, value)

    old = F.regexp_extract(name, ENTITY_OLD_RE, 1)
    known = F.when(end == ";", named(name))
    begun = F.when(old != "", F.concat(named(old), F.substr(name, F.length(old) + 1), end))
    return F.coalesce(char, known, begun, entity)


def decode_entities(c) -> Column:
    """Decode character references in one pass: ``&amp;lt;`` gives ``&lt;``.
    The text is bound once; most texts hold no ``&`` and pass through."""
    def decoded(x):  # the long literal stands in the plan once
        return F.get(F.transform(F.array(F.lit(ENTITY_NAMES)), lambda table: joined(x, table)), F.lit(0))

    def joined(x, table):
        parts = F.arrays_zip(F.split(x, ENTITY_RE).alias("gap"), F.regexp_extract_all(x, F.lit(ENTITY_RE), F.lit(0)).alias("entity"))
        return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(_reference(p["entity"], table), F.lit("")))), "")

    return F.get(F.transform(F.array(col_(c)), lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x)), F.lit(0))


def strip_tags(c) -> Column:
    """Drop every markup tag, keep text between tags."""
    return F.regexp_replace(col_(c), r"<[^>]*>", "")


def count_substr(c, sub: str) -> Column:
    """Occurrences of a literal substring (non-overlapping)."""
    c = col_(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def count_present(c, needles) -> Column:
    """How many of the literal needles occur at least once."""
    c = col_(c)
    return F.size(F.filter(F.array(*[F.lit(x) for x in needles]), lambda n: F.contains(c, n)))


def contains_any(c, needles) -> Column:
    c = col_(c)
    return F.exists(F.array(*[F.lit(x) for x in needles]), lambda n: F.contains(c, n))
