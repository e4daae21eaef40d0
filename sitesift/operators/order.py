"""Numbering rows within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def _placed(rows: DataFrame, by: Sequence[Column], part: str, at: str) -> DataFrame:
    """``rows`` in global order, written once, with their range and place."""
    return cut_lineage(
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at))
    )


def running_sum_within(rows: DataFrame, group: str, order: Sequence[Column], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows of ``group`` (not null)
    that stand before, by ``order``. Windows see the rows of one group in one
    range, and one row per group and range: no task holds a group."""
    part, at = f"__{name}_part", f"__{name}_at"
    placed = _placed(rows, [F.col(group), *order], part, at)
    sums = placed.groupBy(group, part).agg(F.sum(amount).alias("own"))
    sums = sums.select(group, part, (F.sum("own").over(Window.partitionBy(group).orderBy(part)) - F.col("own")).alias("__before"))
    within = F.sum(amount).over(Window.partitionBy(group, part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    return placed.join(sums, [group, part]).withColumn(name, F.col("__before") + within).drop(part, at, "__before")


def number_within(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their number (from 1) within ``group`` (not null) by ``order``.

    A global range sort by group and order splits a large group over many
    tasks; counts per range and their prefix sums turn a row's place in its
    range into its number. The rows are written once; the windows only see one
    row per group and range.
    """
    part, at, shift = (f"__{name}_{x}" for x in ("part", "at", "shift"))
    placed = _placed(rows, [F.col(group), *order], part, at)
    starts = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy(part)) - F.col("n")
    starts = starts.select(group, part, (before - F.col("first")).alias(shift))
    return placed.join(starts, [group, part]).withColumn(name, F.col(at) + F.col(shift) + 1).drop(part, at, shift)
