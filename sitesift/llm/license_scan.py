"""License scans: known license wording found in texts by diagonal voting.

All word k-grams of all texts are hashed and joined to the positions of the
same grams in the templates. A hit at word p of a text and word t of a template
votes for the diagonal p - t, which every gram of one copy shares. Votes are
added up per (text, template, diagonal); diagonals no farther apart than the
edits a template allows are neighbours and merge. What has enough votes is
verified on the words themselves by edit distance.

Nothing is missed: e edits leave at least L - k + 1 - k e of a template's grams
whole, on diagonals that are at most e apart; these are the bounds used. Hits
are few and small. Texts are read again to verify, and pass a broadcast bitmap
of the candidates (of bounded size) before the exact join moves them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.lookup import BITS_PER_URL, MAX_BITS, asked_for
from .common import ascii_lower, scratch, stage

# Fixed value: words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Templates are configuration: up to so many words in all, their grams (24 bytes each) are broadcast.
BROADCAST_WORDS = 200_000

SPANS = "array<struct<template:int,label:string,start:long,length:long,edits:long,score:double>>"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(WORD)


def word_list(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


@dataclass(frozen=True)
class Template:
    """License wording; ``share`` of its words may be edited (0: word for word)."""

    label: str
    text: str
    share: float = 0.0

    @property
    def words(self) -> list[str]:
        return word_list(self.text)

    @property
    def edits(self) -> int:
        """Edits allowed; never so many that a copy could be left without one whole gram."""
        n = len(self.words)
        return max(0, min(math.floor(self.share * n), (n - GRAM) // GRAM))


def text_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns``, at and gram of every k-gram of the array ``words``."""
    n = F.size("words") - GRAM
    grams = F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(GRAM)))))
    return rows.select(*columns, F.posexplode_outer(grams).alias("at", "gram")).where("gram is not null")


def _template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    short = [t.label for t in templates if len(t.words) < GRAM]
    if short:
        raise ValueError(f"templates of fewer than {GRAM} words: {short}")
    rows = [(i, t.edits, len(t.words) - GRAM + 1 - GRAM * t.edits, t.words) for i, t in enumerate(templates)]
    known = spark.createDataFrame(rows, "template int, edits int, need int, words array<string>")
    return _grams(known, "template", "edits", "need").withColumnRenamed("at", "template_at")


def candidates(texts: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """text_id and spots (template and its lowest and highest diagonal) of the
    texts (text_id, words) in which some template has enough votes."""
    known = _template_grams(texts.sparkSession, templates)
    if sum(len(t.words) for t in templates) <= BROADCAST_WORDS:
        known = F.broadcast(known)
    votes = (
        _grams(texts, "text_id").join(known, "gram")
        .groupBy("text_id", "template", "edits", "need", (F.col("at") - F.col("template_at")).alias("diagonal"))
        .agg(F.count_distinct("template_at").alias("votes"))  # equal texts vote alike
    )
    in_order = Window.partitionBy("text_id", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(in_order) > F.col("edits")
    merged = votes.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("band", F.sum("apart").over(in_order))
    return (
        merged.groupBy("text_id", "template", "band", "need")
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
        .where("votes >= need")
        .groupBy("text_id").agg(F.collect_list(F.struct("template", "low", "high")).alias("spots"))
    )


def end_distances(template: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per end 0..n: fewest edits between the template and a stretch that ends there."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for w in template:
        cheaper = row + 1
        cheaper[1:] = np.minimum(cheaper[1:], row[:-1] + (words != w))
        row = np.minimum.accumulate(cheaper - at) + at
    return row


def shortest_stretch(template: np.ndarray, words: np.ndarray, edits: int) -> int:
    """Words of the shortest stretch at the end of ``words`` at that distance from the template."""
    at = np.arange(len(words) + 1)
    row, back = at, words[::-1]
    for w in template[::-1]:
        cheaper = row + 1
        cheaper[1:] = np.minimum(cheaper[1:], row[:-1] + (back != w))
        row = np.minimum.accumulate(cheaper - at) + at
    return int(np.flatnonzero(row == edits)[0])


def verified(words: Sequence[str], template: Template, bands: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, edits) of the template's places on the given bands of
    diagonals: of each series of ends within the allowed edits, the first best."""
    wording, most = template.words, template.edits
    if most == 0:
        n = len(wording)
        return [(low, n, 0) for low, _ in sorted(bands) if list(words[low:low + n]) == wording]
    codes = {w: i for i, w in enumerate(dict.fromkeys(wording))}
    target = np.array([codes[w] for w in wording])
    stretches: list[list[int]] = []
    for low, high in sorted(bands):
        first, last = max(0, low - most), min(len(words), high + len(wording) + most)
        if stretches and first <= stretches[-1][1]:
            stretches[-1][1] = max(last, stretches[-1][1])
        else:
            stretches.append([first, last])
    out = []
    for first, last in stretches:
        here = np.array([codes.get(w, -1) for w in words[first:last]])
        edits = end_distances(target, here)
        near = np.flatnonzero(np.diff(np.concatenate(([0], (edits <= most).astype(np.int8), [0]))))
        for a, b in zip(near[::2], near[1::2]):
            end = int(a + edits[a:b].argmin())
            found = int(edits[end])
            length = shortest_stretch(target, here[max(0, end - len(wording) - most):end], found)
            out.append((first + end - length, length, found))
    return out


def license_spans(docs: DataFrame, templates: Sequence[Template], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words and spans (template number, label,
    start and length in words, edits, score = 1 - edits / words of the
    template) by start, template.

    Equal texts are told by SHA-256 and judged alike. Null or empty text: no
    words, no spans. Null key and repeated rows: each row on its own. Empty
    table: empty result. Other columns are not looked at. The words of one
    text are held at a time.
    """
    spark = docs.sparkSession
    scratch(spark, "license")  # the workers need this package
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.sha2(whole, 256).alias("text_id"), whole.alias("text"))
    spots = stage(candidates(texts.select("text_id", text_words(F.col("text")).alias("words")), templates), "license-spots")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans = [], []
            for text_id, t, found in zip(*(b.column(i).to_pylist() for i in range(3))):
                words, bands = word_list(t), {}
                for s in found:
                    bands.setdefault(s["template"], []).append((s["low"], s["high"]))
                rows = [
                    {"template": i, "label": templates[i].label, "start": start, "length": length, "edits": edits,
                     "score": 1 - edits / len(templates[i].words)}
                    for i, of in bands.items() for start, length, edits in verified(words, templates[i], of)
                ]
                if rows:
                    ids.append(text_id)
                    spans.append(sorted(rows, key=lambda r: (r["start"], r["template"])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(spans, arrow_spans)], ["text_id", "spans"])

    arrow_spans = to_arrow_type(spark.createDataFrame([], f"spans {SPANS}").schema["spans"].dataType)
    n = spots.count()
    if n * BITS_PER_URL <= MAX_BITS:  # else nearly no text would be left out
        texts = asked_for(texts, spots, n, "text_id")
    found = texts.join(spots, "text_id").select("text_id", "text", "spots").mapInArrow(verify, f"text_id string, spans {SPANS}")
    found = stage(found.groupBy("text_id").agg(F.first("spans").alias("spans")), "license-spans")
    rows = docs.select(F.col(key).alias("key"), F.sha2(whole, 256).alias("text_id"), F.size(text_words(whole)).cast("long").alias("n_words"))
    return rows.join(found, "text_id", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )
