"""Quality rules whose cutoffs are certified on labelled documents.

Statistics of a whole text, by column functions only. Each rule rejects a
document when its statistic passes a cutoff. Cutoffs are chosen per stratum
from documents labelled good: a cutoff may be used if the exact binomial test
rejects, at its share of the error level, that it drops more than its share
of good documents. Cutoffs of a rule are tried from the mildest to the
strictest and the first failure ends the search (fixed-sequence testing), so
only the number of strata and rules divides the error level (Bonferroni).
With probability 1 - delta, no stratum loses more than ``max_rejected`` of
its good documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _pairs(hashes: str, shift: int) -> Column:
    """Hash of every element of the column with the one ``shift`` places on."""
    n = F.greatest(F.size(hashes) - shift, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, shift + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered(starts: str) -> Column:
    """Words under windows that begin at the sorted ``starts``."""
    n = F.greatest(F.size(starts) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(starts, 1, n), F.slice(starts, 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g) + F.when(F.size(starts) > 0, F.lit(WINDOW)).otherwise(F.lit(0))


def text_statistics(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words (all long).

    Eight-word windows are first told apart by 64-bit hashes, built in three
    doublings; only in texts where two hashes are equal are the windows
    themselves sorted and compared, so the counts are exact. Every step is a
    projection of its own: an array is built once, however often it is read.
    Elements are read by position (``get``), never by ``slice`` in a loop, so
    the work grows with the text and not with its square.
    """
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("body"))
    d = d.withColumn("ws", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    d = d.select(
        *keep, "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.translate("body", ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("h1"),
    )
    d = d.withColumn("h2", _pairs("h1", 1)).withColumn("h4", _pairs("h2", 2)).withColumn("h8", _pairs("h4", 4))

    def window(i: Column) -> Column:
        words = F.concat_ws(" ", *(F.get("ws", i + k) for k in range(WINDOW)))
        return F.struct(F.get("h8", i).alias("h"), words.alias("w"), i.alias("i"))

    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("h8") - 1), window))
    d = d.withColumn("windows", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), windows))

    def again(x: Column, k: Column) -> Column:
        same = [(F.get("windows", o)["h"] == x["h"]) & (F.get("windows", o)["w"] == x["w"]) for o in (k - 1, k + 1)]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))

    d = d.withColumn("starts", F.array_sort(F.transform(F.filter("windows", again), lambda x: x["i"])))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered("starts"), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


#: Fixed order: (rule, statistic that is high in poor text, cutoffs from the mildest to the strictest).
RULES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01)),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    ("repeated_windows", "n_repeat_words / greatest(n_words, 1)", (0.3, 0.27, 0.24, 0.21, 0.18, 0.15, 0.12, 0.1)),
    ("long_words", "word_chars / greatest(n_words, 1)", (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5)),
    ("short_words", "-(word_chars / greatest(n_words, 1))", (-1.5, -2.0, -2.5, -2.75, -3.0, -3.25, -3.5, -3.75, -4.0)),
)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of n trials at ``rate``, 1 where k is not below its mean."""
    step = F.lit(rate / (1 - rate))
    first = F.struct((n * F.log(F.lit(1 - rate))).alias("log"), F.exp(n * F.log(F.lit(1 - rate))).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + F.lit(1)) / i * step)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    trials = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * F.lit(rate), F.aggregate(trials, first, add, lambda acc: acc["sum"])).otherwise(F.lit(1.0))


def certified_cutoffs(good: DataFrame, max_rejected: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff or null, n_good) from the statistics of documents labelled good.

    A rule's share of the tolerated rejections is ``max_rejected`` / rules; its
    error level is ``delta`` / (strata * rules).
    """
    strata = good.select("stratum").distinct().count()
    share, level = max_rejected / len(RULES), delta / max(1, strata * len(RULES))
    out = None
    for name, statistic, cutoffs in RULES:
        value = F.expr(statistic)
        n = F.count(F.lit(1))
        dropped = good.groupBy("stratum").agg(
            n.alias("n_good"), F.array(*(F.count(F.when(value > c, 1)) for c in cutoffs)).alias("dropped")
        )
        passes = F.transform("dropped", lambda k: binomial_tail(k, F.col("n_good"), share) <= F.lit(level))
        failed = F.array_position(passes, False).cast("int")
        strictest = F.when(failed > 0, failed - 1).otherwise(F.lit(len(cutoffs)))
        rule = dropped.withColumn("strictest", strictest).select(
            "stratum", F.lit(name).alias("rule"),
            F.when(F.col("strictest") > 0, F.element_at(F.array(*map(F.lit, cutoffs)), F.greatest("strictest", F.lit(1)))).alias("cutoff"),
            "n_good",
        )
        out = rule if out is None else out.unionAll(rule)
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
                  max_rejected: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per input row: key, stratum, the statistics, base_failed,
    rejected_by (array of rules) and kept.

    ``labels`` (key, quality): 1 marks a good document; a key with several
    labels is good if all are 1. A null stratum is the stratum ''. In a
    stratum with too few good labels no cutoff is certified, and only the base
    conditions reject. Null or empty text: all statistics 0, base_failed. Null
    key: judged, never labelled. Repeated rows are judged one by one. Empty
    tables: empty result, or no cutoff. Other columns are not looked at.
    """
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"))
    stats = stage(text_statistics(narrow, ["key", "stratum"]), "text-statistics")
    good = labels.groupBy(F.col(key).alias("good_key")).agg(F.min("quality").alias("worst")).where("worst = 1")
    cutoffs = certified_cutoffs(
        stage(stats.join(good, F.col("key") == F.col("good_key"), "left_semi"), "good-statistics"), max_rejected, delta
    )
    cutoffs = cutoffs.groupBy(F.col("stratum").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.array_compact(F.array(*(
        F.when(F.expr(statistic) > F.col("cutoffs")[name], F.lit(name)) for name, statistic, _ in RULES
    )))
    return (
        stats.join(cutoffs, F.col("stratum") == F.col("s"), "left")
        .withColumn("base_failed", base)
        .withColumn("rejected_by", rejected)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .select(
            F.col("key").alias(key), "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
            "n_repeat_words", "base_failed", "rejected_by", "kept",
        )
    )
