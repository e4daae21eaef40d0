"""Query op6: toxicity of all documents."""

from __future__ import annotations

from .common import read
from .registry import register
from .toxicity import score


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Score and prediction of every document, learned from the labels."""
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
