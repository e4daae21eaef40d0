"""Paragraph chunking as array folds (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

PARAGRAPH_SEP = "\n\n"
# Chunking policy.
CHUNK_TRIGGER_FACTOR = 1.5   # only content longer than 1.5 x max is chunked
CHUNK_MAX_PIECES = 3         # accept at most three pieces ...
CHUNK_MIN_PIECE = 1000       # ... each longer than 1,000 characters
DEFAULT_CHUNK_SIZE = 8000    # library default
API_CHUNK_SIZE = 6000        # web API profile


def chunk_starts(paragraphs: Column, max_size) -> Column:
    """1-based index of the first paragraph of every chunk (greedy packing).

    A running length gets len(p) + 2 for every appended paragraph and is
    reset to the bare len(p) when a new chunk starts (so later chunks may
    reach max + 2). One pass; the start list only grows on a flush.
    """
    m = max_size if isinstance(max_size, Column) else F.lit(int(max_size))
    init = F.struct(
        F.array(F.lit(1)).alias("starts"),
        F.lit(0).cast("long").alias("cur_len"),
        F.lit(0).alias("n_cur"),
        F.lit(0).alias("i"),
    )

    def step(acc, p):
        plen = F.length(p).cast("long")
        i = acc["i"] + 1
        flush = (acc["cur_len"] + plen > m) & (acc["n_cur"] > 0)
        return F.struct(
            F.when(flush, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
            F.when(flush, plen).otherwise(acc["cur_len"] + plen + 2).alias("cur_len"),
            F.when(flush, F.lit(1)).otherwise(acc["n_cur"] + 1).alias("n_cur"),
            i.alias("i"),
        )

    return F.aggregate(paragraphs, init, step)["starts"]


def chunks_from_starts(paragraphs: Column, starts: Column) -> Column:
    """Join each contiguous paragraph range back with blank lines."""
    n = F.size(paragraphs)
    return F.transform(
        starts,
        lambda s, k: F.array_join(
            F.slice(paragraphs, s, F.coalesce(F.try_element_at(starts, k + 2), n + 1) - s), PARAGRAPH_SEP
        ),
    )


def chunk_content(content, max_size) -> Column:
    """Split at blank lines into chunks of at most ``max_size`` (+2 slack).

    Column form for small use; ``operators.chunking`` stages the steps.
    """
    paras = F.split(col_(content), PARAGRAPH_SEP)
    return chunks_from_starts(paras, chunk_starts(paras, max_size))


def pieces(title: Column, content: Column, chunks: Column, max_size: Column) -> Column:
    """Array of (title, content) pieces for one item, following the policy.

    Content longer than 1.5 x max is split; the split is kept only if it
    gives at most three pieces, each over 1,000 characters. Titles get
    ' (Part i)' when there is more than one piece. ``chunks`` is NULL for
    items that are not eligible.
    """
    n = F.size(chunks)
    good = chunks.isNotNull() & (n <= CHUNK_MAX_PIECES) & F.forall(chunks, lambda x: F.length(x) > CHUNK_MIN_PIECE)
    parts = F.transform(
        chunks,
        lambda x, i: F.struct(
            F.when(n > 1, F.concat(title, F.lit(" (Part "), (i + 1).cast("string"), F.lit(")"))).otherwise(title).alias("title"),
            x.alias("content"),
        ),
    )
    whole = F.array(F.struct(title.alias("title"), content.alias("content")))
    return F.when(good, parts).otherwise(whole)


def eligible(content: Column, max_size: Column) -> Column:
    return F.length(content) > F.lit(CHUNK_TRIGGER_FACTOR) * max_size
