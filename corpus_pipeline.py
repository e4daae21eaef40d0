"""The corpus pipeline: toxic documents go, one of each near-duplicate group
stays, secrets are blanked, sources are mixed, and the rest is packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.

A stage's own tables go when the next stage begins, as its result is written
by then: run the stages of one pipeline one after the other.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sitesift.llm.common import file_row, free, read, scratch, scratch_of, stage
from sitesift.llm.minhash import one_of_each
from sitesift.llm.mix import mixed_documents
from sitesift.llm.q01_mix import curriculum
from sitesift.llm.q08_packing import packed
from sitesift.llm.secret_scan import Ledger, redacted
from sitesift.llm.toxicity import without_toxic


_left: list[str] = []  # the tables of the stage before


def _stage(function):
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark, _left)
        with scratch_of() as tables:
            out = function(spark, docs, sf_dir)
        _left[:] = tables
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8 or more."""
    return one_of_each(docs, part=80, row=file_row(docs))


@_stage
def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return redacted(docs, Ledger(spark, scratch(spark, "ledger")))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents by the curriculum, in training order."""
    return mixed_documents(docs, curriculum, whole=True, row=file_row(docs))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", blank_secrets),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores and trained tokenizers are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
