"""Content titles and content-type classification as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col_, contains_any, count_present, py_split, py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
# ---------------------------------------------------------------------------
PLATFORM_RULES = [
    ("substack.com", "blog"),
    ("medium.com", "blog"),
    ("linkedin.com", "linkedin_post"),
    ("reddit.com", "reddit_comment"),
]
KEYWORD_RULES = [
    ("podcast_transcript", ["podcast", "episode", "transcript", "audio", "listen"]),
    ("call_transcript", ["transcript", "interview", "conversation", "call", "recording"]),
    ("book", ["book", "chapter", "manual", "documentation", "reference"]),
    ("news", ["/news/", "breaking", "announcement", "press-release", "update"]),
]
TUTORIAL_PHRASES = [
    "step 1", "step one", "first step", "tutorial:", "how to",
    "walkthrough", "guide:", "instructions", "follow these steps",
]
NUMBERED_STEP_RE = r"^[1-5]\."
TUTORIAL_MIN_WORDS = 100
NUMBERED_WINDOW = 200

CONTENT_TYPES = [
    "blog", "linkedin_post", "reddit_comment", "podcast_transcript",
    "call_transcript", "book", "news", "tutorial",
]

def title_from_markdown(content) -> Column:
    """Text of the first stripped line starting with '# ', else 'Untitled'."""
    lines = F.filter(F.split(col_(content), "\n"), lambda line: py_strip(line).startswith("# "))
    first = F.try_element_at(lines, F.lit(1))
    return F.when(first.isNotNull(), py_strip(F.substring(py_strip(first), 3, 1 << 30))).otherwise(F.lit("Untitled"))


def title_or_markdown(meta_title, content) -> Column:
    m = col_(meta_title)
    return F.when(m.isNotNull() & (m != ""), m).otherwise(title_from_markdown(content))


def is_tutorial(content) -> Column:
    low = F.lower(col_(content))
    words = py_split(low)
    numbered = F.size(F.filter(F.slice(words, 1, NUMBERED_WINDOW), lambda w: w.rlike(NUMBERED_STEP_RE)))
    return (F.size(words) > TUTORIAL_MIN_WORDS) & (
        (count_present(low, TUTORIAL_PHRASES) >= 2) | (numbered >= 3)
    )


def classify(url, title, content) -> Column:
    """One of the eight content types; rules are tried in a fixed order."""
    u = F.lower(col_(url))
    t = F.lower(col_(title))
    out = F.when(is_tutorial(content), F.lit("tutorial")).otherwise(F.lit("blog"))
    for label, words in reversed(KEYWORD_RULES):
        out = F.when(contains_any(u, words) | contains_any(t, words), F.lit(label)).otherwise(out)
    for needle, label in reversed(PLATFORM_RULES):
        out = F.when(u.contains(needle), F.lit(label)).otherwise(out)
    return out


def _tutorial_rule(low: Column, words: Column) -> Column:
    numbered = F.size(F.filter(F.slice(words, 1, NUMBERED_WINDOW), lambda w: w.rlike(NUMBERED_STEP_RE)))
    return (F.size(words) > TUTORIAL_MIN_WORDS) & ((count_present(low, TUTORIAL_PHRASES) >= 2) | (numbered >= 3))


def with_content_type(df: DataFrame, url: str, title: str, content: str, out: str) -> DataFrame:
    """Staged ``classify``: lower-cased content and its words computed once."""
    t = "__ct_"
    df = df.withColumn(t + "low", F.lower(F.col(content)))
    df = df.withColumn(t + "words", py_split(F.col(t + "low")))
    u, ti = F.lower(F.col(url)), F.lower(F.col(title))
    res = F.when(_tutorial_rule(F.col(t + "low"), F.col(t + "words")), F.lit("tutorial")).otherwise(F.lit("blog"))
    for label, words in reversed(KEYWORD_RULES):
        res = F.when(contains_any(u, words) | contains_any(ti, words), F.lit(label)).otherwise(res)
    for needle, label in reversed(PLATFORM_RULES):
        res = F.when(u.contains(needle), F.lit(label)).otherwise(res)
    return df.withColumn(out, F.when(F.col(content).isNotNull(), res)).drop(t + "low", t + "words")
