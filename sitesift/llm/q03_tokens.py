"""Query op3: token counts of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .registry import register
from .tokens import token_counts

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048


@register("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    """Bytes, tokens and the length verdict of every document."""
    import public_tokenizers

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
