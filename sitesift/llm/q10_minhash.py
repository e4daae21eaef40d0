"""Query op10: near-duplicates among all documents."""

from __future__ import annotations

from .common import read
from .minhash import near_duplicates
from .registry import register


@register("op10_minhash_dedup")
def op10_minhash_dedup(spark, sf_dir):
    """Shingles, component and verdict of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"), part=85)
