"""Query op8: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .packing import pack
from .registry import register

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def packed(docs):
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path(TOKENIZER), ranks=public_tokenizers.path(RANKS))
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op8_packing")
def op8_packing(spark, sf_dir):
    """The pieces of every document, in windows of the corpus mixture."""
    return packed(read(spark, sf_dir, "documents"))
