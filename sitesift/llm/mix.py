"""Mixing sources to target weights along a training curriculum.

Every source has a weight schedule over training time t in [0, 1], given as
knots (t, weight) joined by straight lines. Its integral is the source's
overall weight; the overall weights share the token total, with no source
above ``max_repeat`` times its own size (the excess goes to the others by
weight). The cumulative demand of a source up to t is its target times the
integral of its schedule up to t over the whole integral. Documents of a
source queue in a fixed pseudo-random order, as many times over as the
target needs; inverting the demand at the words queued before a copy gives
the copy's training position, and a global range sort by position gives the
training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stage, words

Knots = Sequence[tuple[float, float]]

#: Sources are configuration: their totals are planned on the driver.
MAX_SOURCES = 100_000

PLACEMENT = "array<struct<position:double,words:bigint>>"


def schedule_segments(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """(start, weight, slope, area before, area after) of each straight piece."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("a schedule runs from t = 0 to t = 1 in increasing steps")
    if any(w < 0 for _, w in knots) or all(w == 0 for _, w in knots):
        raise ValueError("weights are not negative, and one is positive")
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        after = area + (w0 + w1) / 2 * (t1 - t0)
        out.append((float(t0), float(w0), (w1 - w0) / (t1 - t0), area, after))
        area = after
    return out


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: int, max_repeat: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``max_repeat * size``: sources
    fill up in order of cap over weight, the rest share what is left."""
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (max_repeat * sizes[i] / weights[i], i))
    left, weight = total, sum(weights[i] for i in order)
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        if max_repeat * sizes[i] * weight >= weights[i] * left:
            for j in order[k:]:
                out[j] = float(weights[j]) * left / weight
            break
        out[i] = float(max_repeat * sizes[i])
        left, weight = left - max_repeat * sizes[i], weight - weights[i]
    return out


SEGMENT = ("t0", "w0", "slope", "a0", "a1")
PLAN = pa.schema({
    "sid": pa.int32(), "source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "quota": pa.int64(), "buckets": pa.int32(),
    "segments": pa.list_(pa.struct(dict.fromkeys(SEGMENT, pa.float64()))),
})


def _plan(spark: SparkSession, totals: list, schedule_of, total: int | None, max_repeat: int) -> DataFrame:
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    schedules = [schedule_segments(schedule_of(i, r.source)) for i, r in enumerate(totals)]
    sizes = [int(r.source_size) for r in totals]
    targets = capped_targets(sizes, [s[-1][4] for s in schedules], sum(sizes) if total is None else total, max_repeat)
    rows = [
        (i, r.source, sizes[i], float(targets[i]), math.floor(targets[i] + 0.5), max(1, round(r.rows ** 0.5)),
         [dict(zip(SEGMENT, map(float, s))) for s in schedules[i]])
        for i, r in enumerate(totals)
    ]
    # as Arrow: a list of rows would start Python workers
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(PLAN.names, r)) for r in rows], PLAN))


def _position(queued: Column) -> Column:
    """Training time at which the source's demand reaches ``queued`` words."""
    area = F.element_at("segments", -1)["a1"] * queued / F.greatest(F.col("quota"), F.lit(1))  # no quota: no copy has a position
    seg = F.coalesce(
        F.get(F.filter("segments", lambda s: area < s["a1"]), F.lit(0)), F.element_at("segments", -1)
    )
    rest = F.greatest(area - seg["a0"], F.lit(0.0))
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + F.lit(2.0) * seg["slope"] * rest, F.lit(0.0)))
    return seg["t0"] + F.when(rest > 0, F.lit(2.0) * rest / (seg["w0"] + root)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, schedule_of, *, total: int | None = None, max_repeat: int = 3, key: str = "doc_id",
        source: str = "source", text: str = "text", queue: str | None = None) -> DataFrame:
    """One row per input row: key, source, size (words), source_size, target,
    taken (words, repeats counted), position (of the first copy, null if none)
    and placements (position and words of every copy).

    ``schedule_of(i, source)`` gives the knots of the i-th source by code
    point (null last). The last copy a source needs is cut at its quota, so
    taken words equal the rounded target. Prefix sums run in two levels,
    about sqrt(rows) hash ranges per source and the rows of each, so that a
    source with a third of all rows is no single group; the queue order is the
    md5 of the key (of ``queue``, if named, which need not be unique), then key,
    size and text hash, so reruns agree.

    Null key: queued first. Null or empty text: size 0, taken 0. Repeated
    rows: each queued on its own. A source without words: target and taken 0,
    no placements; a table without words: the same for all. Empty table:
    empty result. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    u = F.conv(F.substring(F.md5(F.col(queue or key).cast("string")), 1, 13), 16, 10).cast("long")
    sized = stage(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.size(words(F.col(text))).cast("long").alias("size"),
            F.coalesce(u, F.lit(0).cast("long")).alias("u"),
            F.xxhash64(F.col(text)).alias("tie"),
        ),
        "mix-sized",
    )
    totals = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
        .limit(MAX_SOURCES + 1).collect()
    )
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = _plan(spark, totals, schedule_of, total, max_repeat)
    queued = sized.join(F.broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).select(
        "key", "source", "size", "u", "tie", "sid", "source_size", "target", "quota", "segments",
        F.floor(F.col("u") / F.lit(float(2**52)) * F.col("buckets")).cast("int").alias("bucket"),
    )
    ranges = queued.groupBy("sid", "bucket").agg(F.sum("size").alias("range_size"))
    ranges = ranges.select(
        "sid", "bucket",
        (F.sum("range_size").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("range_size")).alias("ranges_before"),
    )
    order = ("u", "size", "tie", "key") if queue else ("u", "key", "size", "tie")
    within = Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("ranges_before") + F.sum("size").over(within) - F.col("size")
    size, all_words = F.col("size"), F.greatest(F.col("source_size"), F.lit(1))
    full = F.floor(F.col("quota") / all_words)  # exact: quota is at most a few times source_size
    last = F.least(F.greatest(F.col("quota") - F.col("full") * F.col("source_size") - F.col("before"), F.lit(0)), size)
    placed = (
        queued.join(ranges, ["sid", "bucket"])
        .withColumn("before", before)
        .withColumn("full", full)
        .withColumn("last", last.cast("long"))
        .withColumn(
            "placements",
            F.filter(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), F.col("full")),
                    lambda k: F.struct(
                        _position(k * F.col("source_size") + F.col("before")).alias("position"),
                        F.when(k < F.col("full"), size).otherwise(F.col("last")).alias("words"),
                    ),
                ),
                lambda p: p["words"] > 0,
            ).cast(PLACEMENT),
        )
    )
    return placed.select(
        F.col("key").alias(key), "source", "size", "source_size", "target",
        (F.col("full") * size + F.col("last")).cast("long").alias("taken"),
        F.get("placements", F.lit(0))["position"].alias("position"),
        "placements", "u",
    )


def training_order(mixed: DataFrame, *by: str) -> DataFrame:
    """Global range sort by first position (ties by hash, so that one shared
    position, or the rows never taken, spread over many ranges)."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "u", *by)


def mixed_documents(docs: DataFrame, schedule_of, *, max_repeat: int = 3, whole: bool = False, key: str = "doc_id",
                    row: Column | None = None) -> DataFrame:
    """The mix as documents: one row per copy, in training order, with the
    columns of ``docs``. The copy cut at its source's quota ends after its
    last counted word, and n_chars follows; with ``whole`` it is taken or left
    as a whole, whichever is nearer to the quota (taken at half). Documents
    without words are never taken.

    ``row`` names the rows of a stored table (``common.file_row``); without it
    ``docs`` is written once with a number per row. Rows queue by ``key``, if
    ``docs`` has it. Texts are shuffled twice: to their copies and by position.
    """
    rid, size, place, u = (fresh(docs, c) for c in ("mix_row", "mix_size", "mix_place", "mix_u"))
    if row is None:
        kept = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-documents")
    else:
        kept = docs.withColumn(rid, row)
    copies = mix(kept, schedule_of, max_repeat=max_repeat, key=rid, queue=key if key in docs.columns else None).select(
        rid, F.col("size").alias(size), F.col("u").alias(u), F.explode("placements").alias(place)
    )
    if whole:
        nearer = copies.where(F.col(place)["words"] * 2 >= F.col(size))
        return kept.join(nearer, rid).orderBy(F.col(place)["position"], u).select(*docs.columns)
    n = F.col(place)["words"].cast("int")
    head = F.array_join(
        F.zip_with(F.slice(F.split("text", WORD), 1, n), F.slice(words("text"), 1, n), lambda gap, w: F.concat(gap, w)), ""
    )
    uncut = n == F.col(size)
    out = kept.join(copies, rid)
    cut = {"text": F.when(uncut, F.col("text")).otherwise(head)}
    if "n_chars" in docs.columns:
        cut["n_chars"] = F.when(uncut, F.col("n_chars")).otherwise(F.char_length(head)).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(cut).orderBy(F.col(place)["position"], u).select(*docs.columns)
