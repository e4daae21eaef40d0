"""Chunking of long items (C2, C3, W10) -- map-only, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import DEFAULT_CHUNK_SIZE, PARAGRAPH_SEP, chunk_starts, chunks_from_starts, eligible, pieces


def chunk_items(items: DataFrame, chunk_size=DEFAULT_CHUNK_SIZE) -> DataFrame:
    """One row per piece; ``part`` is 1-based (1 for unsplit items).

    ``chunk_size`` is an int or a Column (per-site size from ``sites``).
    """
    size = chunk_size if not isinstance(chunk_size, (int, str)) else (
        F.col(chunk_size) if isinstance(chunk_size, str) else F.lit(chunk_size)
    )
    cols = [c for c in items.columns if c not in ("title", "content")]
    t = "__ck_"
    d = items.withColumn(t + "m", size)
    # only eligible items are split; each step is its own projection
    d = d.withColumn(t + "paras", F.when(eligible(F.col("content"), F.col(t + "m")), F.split("content", PARAGRAPH_SEP)))
    d = d.withColumn(t + "starts", chunk_starts(F.col(t + "paras"), F.col(t + "m")))
    d = d.withColumn(t + "chunks", chunks_from_starts(F.col(t + "paras"), F.col(t + "starts")))
    d = d.withColumn(t + "pieces", pieces(F.col("title"), F.col("content"), F.col(t + "chunks"), F.col(t + "m")))
    # an outer generator: an inner one would push a non-empty test, with all steps inlined, down to the scan
    return d.select(*cols, F.posexplode_outer(t + "pieces").alias("part0", "piece")).where("part0 is not null").select(
        *cols,
        (F.col("part0") + 1).alias("part"),
        F.col("piece.title").alias("title"),
        F.col("piece.content").alias("content"),
    )


def process_items(items: DataFrame, chunk_size=DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Dedup, then chunk."""
    from .dedup import deduplicate

    return chunk_items(deduplicate(items), chunk_size)
