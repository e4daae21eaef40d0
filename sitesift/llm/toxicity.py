"""Toxicity scores: gradient-boosted trees over dense text features, calibrated.

A lexicon of stems (word starts and short words) is learned from labelled
training documents by a likelihood-ratio test against the toxic share. A
document becomes a short vector of densities and rates, boosted trees score
it, and isotonic regression on a fold of its own turns the score into a
probability. Labels are the only thing learned from; key, language and source
are never features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import KEPT_CHARS, fresh, sliced, stage

#: Labelled rows that a model is fitted on at most (smallest hashes first).
MAX_LABELS = 200_000
MAX_STEMS = 2_000
MIN_RATIO = 20.0
STEMS = (4, 5, 6)
#: Words of the text a task remembers.
TASK_WORDS = 100_000
NEAR, BURST = 5, 50
#: Code points whose class is kept in a table; those beyond are looked at one by one.
TABLE = 0x3000

# Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os vuestro".split()
)
# Characters that stand for letters.
LOOKALIKES = str.maketrans("0134578@$!|", "oieastbasil")
FEATURES = (
    "hits_100", "log_hits", "weight", "distinct_hits", "hidden_100", "burst", "near_you", "you_100", "near_gap",
    "caps_words", "caps_letters", "exclaims", "punctuation", "runs", "mixed_words", "log_words",
)

_EDGE = re.compile(r"^\W+|\W+$")
_SPLITTERS = re.compile(r"[.\-_*'~+]")
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\d@$!|*_~+]")
_RUN = re.compile(r"[!?]{2,}|(\w)\1\1\1")
_EXCLAIM, _PUNCT, _UPPER = re.compile(r"[!?]"), re.compile(r"[^\w\s]"), re.compile(r"[A-Z\xc0-\xd6\xd8-\xde]")


def stems_of(word: str) -> list[str]:
    return [word, *(word[:n] for n in STEMS if len(word) > n)]


def plain(word: str) -> str:
    return _EDGE.sub("", word.lower())


def unmasked(word: str) -> str:
    """The word a writer may have hidden: lookalikes, inner marks and stretched letters undone."""
    return re.sub(r"(\w)\1{2,}", r"\1", _SPLITTERS.sub("", _EDGE.sub("", word.lower()).translate(LOOKALIKES)))


class WordInfo(dict):
    """Word -> flags + 32 * (number of its lexicon stem, 0 for none); flags are
    1 lexicon, 2 second person, 4 capitals, 8 mixed, 16 hidden lexicon. Words
    are looked into once and remembered."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.stems = [None, *lexicon]
        self.number = {s: i for i, s in enumerate(self.stems)}
        self.weights = [0.0, *lexicon.values()]

    def find(self, word: str) -> str | None:
        """The stem with the largest weight, the first of equal ones."""
        best, most, weight = None, -math.inf, self.lexicon.get
        for s in (word, word[:4], word[:5], word[:6]):  # as stems_of: a short word is its own start
            w = weight(s)
            if w is not None and w > most:
                best, most = s, w
        return best

    def __missing__(self, word: str) -> int:
        inner = word.rstrip(".,;:")
        if inner.isalpha() and (inner.islower() or inner.isascii()):  # most words: letters, and the end of a clause
            base, mixed = inner.lower(), False
            masked = _RUN.search(inner)
        else:
            base, inner = plain(word), _EDGE.sub("", word)
            mixed = bool(_LETTER.search(word) and _OTHER.search(inner))
            masked = mixed or _SPLITTERS.search(inner) or _RUN.search(word)
        stem, flags = self.find(base), 0
        if stem is None and masked and (stem := self.find(unmasked(word))):
            flags |= 16
        flags |= (stem is not None) | 2 * (base in SECOND_PERSON) | 4 * (len(inner) > 1 and inner.isupper()) | 8 * mixed
        code = flags + 32 * self.number[stem]
        if len(word) <= KEPT_CHARS:
            if len(self) >= TASK_WORDS:
                self.clear()
            self[word] = code
        return code

    def __call__(self, word: str) -> tuple[int, float, str | None]:
        code = self[word]
        return code & 31, self.weights[code >> 5], self.stems[code >> 5]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point below ``TABLE``: 1 for an upper-case Latin letter, 2 for punctuation."""
    return np.array([bool(_UPPER.match(chr(c))) + 2 * bool(_PUNCT.match(chr(c))) for c in range(TABLE)], np.uint8)


def char_counts(text: str) -> tuple[int, int, int, int]:
    """Matches of ``_UPPER``, ``_EXCLAIM``, ``_PUNCT`` and ``_RUN``, by arrays
    instead of patterns where that gives the same."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _classes()[np.minimum(codes, TABLE - 1)]
    far = codes >= TABLE
    if far.any():
        known = known[~far]
        rest = len(_PUNCT.findall("".join(map(chr, codes[far].tolist()))))
    else:
        rest = 0
    same = codes[1:] == codes[:-1]
    marks = (codes == 33) | (codes == 63)
    runs = (same[2:] & same[1:-1] & same[:-2]).any() or (marks[1:] & marks[:-1]).any()
    return (int((known & 1).sum()), int(marks.sum()), int((known >> 1).sum()) + rest,
            sum(1 for _ in _RUN.finditer(text)) if runs else 0)


def features(text: str, info: WordInfo) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    found = np.fromiter(map(info.__getitem__, words), np.int64, n)
    flags = found & 31
    hits, you = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
    stems = (found[hits] >> 5).tolist()
    chars = len(text)
    near = gap = 0.0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        dist = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near, gap = float((dist <= NEAR).mean()), 1.0 / (1.0 + float(dist.min()))
    burst = float((np.searchsorted(hits, hits + BURST) - np.arange(len(hits))).max()) if len(hits) else 0.0
    share = 100.0 / n
    upper, exclaims, punctuation, runs = char_counts(text)
    return [
        len(hits) * share, math.log1p(len(hits)), sum(info.weights[s] for s in stems) * share, float(len(set(stems))),
        float((flags & 16 > 0).sum()) * share, burst, near, len(you) * share, gap,
        float((flags & 4 > 0).mean()), upper / chars, 100.0 * exclaims / chars,
        100.0 * punctuation / chars, 100.0 * runs / chars,
        float((flags & 8 > 0).mean()), math.log1p(n),
    ]


def learn_lexicon(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> dict[str, float]:
    """Stem -> log odds, of the stems whose documents are toxic far more often
    than documents are: G-squared of at least ``MIN_RATIO``, the strongest
    ``MAX_STEMS``. ``labelled`` holds at most ``MAX_LABELS`` rows."""

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in sliced(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(known) >= TASK_WORDS:
                    known.clear()
                words = set((t or "").split())
                for w in words.difference(known):
                    known[w] = [s for s in stems_of(plain(w)) if s]
                own = sorted({s for w in words for s in known[w]})
                for w in words:
                    if len(w) > KEPT_CHARS:
                        del known[w]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32())], ["stem", "y"])

    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(toxic).cast("long")).alias("y")).first()
    if not total.n or not total.y or total.y == total.n:
        return {}
    p = total.y / total.n
    df = labelled.select(F.col(text), F.col(toxic).cast("int")).mapInArrow(stems, "stem string, y int")
    df = df.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    y, n = F.col("y"), F.col("n")

    def part(count: Column, share: float) -> Column:
        return F.when(count > 0, count * F.log(count / n / F.lit(share))).otherwise(F.lit(0.0))

    df = df.withColumn("g", 2 * (part(y, p) + part(n - y, 1 - p))).withColumn("odds", F.log((y + 0.5) / (n - y + 0.5) * F.lit((1 - p) / p)))
    best = df.where((F.col("g") >= MIN_RATIO) & (F.col("odds") > 1.5)).orderBy(F.desc("g"), "stem").limit(MAX_STEMS)
    return {r.stem: r.odds for r in best.select("stem", "odds").collect()}


def with_features(docs: DataFrame, text: str, lexicon: dict[str, float], name: str) -> DataFrame:
    """``docs`` plus the feature array ``name``, row by row."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    at, fields = docs.columns.index(text), [*docs.columns, name]
    types = [to_arrow_type(f.dataType) for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = WordInfo(words.value)
        for b in sliced(batches):
            rows = [features(t or "", info) for t in b.column(at).to_pylist()]
            kept = [c.cast(t) for c, t in zip(b.columns, types)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.float64()))], fields)

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    """Lexicon, trees and calibration; without trees every score is ``share``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def raw(self, rows: DataFrame, vector: str, p: str) -> DataFrame:
        """``rows`` plus the trees' probability ``p`` from the feature array ``vector``."""
        names = [fresh(rows, c) for c in ("tox_vector", "tox_raw", "tox_probability", "tox_label")]
        trees = self.trees.copy({self.trees.featuresCol: names[0], self.trees.rawPredictionCol: names[1],
                                 self.trees.probabilityCol: names[2], self.trees.predictionCol: names[3]})
        out = trees.transform(rows.withColumn(names[0], array_to_vector(vector)))
        return out.withColumn(p, vector_to_array(names[2])[1]).drop(*names, vector)

    def apply(self, docs: DataFrame, score: str, text: str = "text") -> DataFrame:
        """``docs`` plus the column ``score``; no shuffle, no join."""
        if self.trees is None:
            return docs.withColumn(score, F.lit(self.share))
        vector, level = fresh(docs, "tox_features"), fresh(docs, "tox_level")
        out = self.raw(with_features(docs, text, self.lexicon, vector), vector, score)
        if self.calibration:
            # a little of the raw score keeps the order within a level
            out = self.calibration.copy({self.calibration.featuresCol: score, self.calibration.predictionCol: level}).transform(out)
            out = out.withColumn(score, F.lit(0.99) * F.col(level) + F.lit(0.01) * F.col(score)).drop(level)
        return out.withColumn(score, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def fold_of(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        max_labels: int = MAX_LABELS, trees: int = 20, depth: int = 4, seed: int = 7) -> Model:
    """Learn from rows whose crc32(key as text) mod 5 is not 0: remainders 1
    to 3 give lexicon and trees, 4 the calibration, from at most
    ``max_labels`` labelled keys (those with the smallest hashes). A key with
    several labels is toxic if one of them is 1; null labels count as none."""
    known = (
        labels.where(F.col(toxic).isNotNull() & (fold_of(key) != 0)).groupBy(F.col(key).alias("label_key"), fold_of(key).alias("fold"))
        .agg(F.max(F.col(toxic).cast("int")).alias("toxic")).withColumn("order", F.xxhash64("label_key"))
    )
    # A bound on the hash leaves little more than max_labels rows to sort (five
    # deviations more than wanted, of hashes that are as good as random).
    total = known.count()
    wanted = max_labels + 5 * max_labels ** 0.5 + 100
    if total > wanted:
        known = known.where(F.col("order") <= F.lit(int(-(2**63) + wanted / total * 2**64)))
    known = known.orderBy("order", "label_key").limit(max_labels).drop("order")
    known = stage(known, "labels")  # at most max_labels narrow rows, so they can be broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), F.col("label_key") == F.col("key"))
    rows = stage(rows.select("fold", "toxic", "text"), "labelled-texts")
    lexicon = learn_lexicon(rows.where("fold <> 4"))
    train = stage(
        with_features(rows, "text", lexicon, "features").select("fold", F.col("toxic").cast("double").alias("label"), "features"),
        "toxicity-train",
    )
    split = train.groupBy((F.col("fold") != 4).alias("fit")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    counts = {r.fit: (r.n, r.y) for r in split.collect()}
    share = sum(c[1] for c in counts.values()) / max(1, sum(c[0] for c in counts.values()))
    (n, y), (m, z) = counts.get(True, (0, 0.0)), counts.get(False, (0, 0.0))
    if not 0 < y < n:
        return Model(lexicon, None, None, share)
    gbt = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed,
                        minInstancesPerNode=max(1, min(5, n // 100)))
    model = Model(lexicon, gbt.fit(train.where("fold <> 4").withColumn("vector", array_to_vector("features"))), None, share)
    if 0 < z < m:
        held = model.raw(train.where("fold = 4").select("label", "features"), "features", "p")
        # equal scores count as one, with their weight: few distinct scores would else be few partitions
        held = held.groupBy("p").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        model.calibration = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(held)
    return model


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: key, held_out, score (0 to 1), predicted.

    Null or empty text is scored from an all-zero vector. Null key: scored,
    never labelled, not held out. Repeated rows are scored one by one. Without
    training labels of both classes every score is the toxic share of the
    labels (0 without labels). Empty table: empty result. Other columns are
    not looked at.
    """
    model = fit(docs, labels, key=key, text=text, **options)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return model.apply(rows, "score").select(
        F.col("key").alias(key), F.coalesce(fold_of("key") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the score does not predict to be toxic, all columns kept."""
    name = fresh(docs, "tox_score")
    return fit(docs, labels, **options).apply(docs, name).where(F.col(name) < 0.5).select(*docs.columns)
