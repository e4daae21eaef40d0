"""Merkle manifest of a data set: a digest per row, a subroot per source and one root.

Rows of a source stand in key order; every ``fan_out`` consecutive digests (the
last run may hold fewer) hash to their parent until one is left, the subroot.
Subroots, in the order of their sources, go up to the root in the same way.

Each level is one window over runs of consecutive nodes: ``fan_out - 1`` lag
and as many lead columns, masked by a node's slot and its run's length, give
the siblings on both sides, and the first child of a run hashes its own digest
and the leads to the parent. Node numbers come from a global range sort,
counts per range and prefix sums, and windows hold one run, so a source with a
third of all rows is no single task. Texts are hashed where they are read and
never shuffled; the path of upper siblings is joined once per run of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

FAN_OUT = 16


def record_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields in order: ``-`` for a null, else
    the value's UTF-8 byte count, ``:`` and the value (numbers in decimal)."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the way up, left to right on each level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["left"], digest, p["right"]), 256))


def _numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with n (from 0 within the group, by ``order``) and size (rows of the group)."""
    by = (group, *order)
    ordered = stage(
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")),
        "merkle-ordered",
    )
    starts = ordered.groupBy(group, "range").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    of_group = Window.partitionBy(group)
    starts = starts.select(
        group, "range",
        (F.sum("rows").over(of_group.orderBy("range")) - F.col("rows") - F.col("first")).alias("shift"),
        F.sum("rows").over(of_group).alias("size"),
    )
    return ordered.join(starts, [group, "range"]).withColumn("n", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def _level(nodes: DataFrame, fan_out: int) -> DataFrame:
    """``nodes`` (node, n, size, digest, ...) with run, slot, left, right
    (digests of the siblings on either side) and, at slot 0, parent."""
    placed = nodes.withColumns({
        "run": F.floor(F.col("n") / F.lit(fan_out)),
        "slot": F.pmod(F.col("n"), F.lit(fan_out)),
    })
    length = F.least(F.lit(fan_out), F.col("size") - F.col("run") * fan_out)
    w = Window.partitionBy("node", "run").orderBy("slot")
    steps = range(1, fan_out)
    left = [F.when(F.col("slot") >= i, F.lag("digest", i).over(w)) for i in reversed(steps)]
    right = [F.when(F.col("slot") + i < length, F.lead("digest", i).over(w)) for i in steps]
    return placed.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)}).withColumn(
        "parent", F.when(F.col("slot") == 0, F.sha2(F.concat("digest", "right"), 256))
    )


def _levels(leaves: DataFrame, fan_out: int) -> list[DataFrame]:
    """``leaves`` and the nodes above them, level by level, until every tree has one."""
    out, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        parents = _level(out[-1].where("size > 1").select("node", "n", "size", "digest"), fan_out).where("slot = 0")
        out.append(stage(
            parents.select("node", F.col("run").alias("n"), F.ceil(F.col("size") / fan_out).alias("size"), F.col("parent").alias("digest")),
            "merkle-level",
        ))
        most = -(-most // fan_out)
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """node, digest: what remains of each tree."""
    tops = [nodes.where("size = 1").select("node", "digest") for nodes in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _with_paths(levels: list[DataFrame], tops: DataFrame, fan_out: int) -> DataFrame:
    """The lowest level with each node's path (siblings from its own level up)
    and the further columns of ``tops`` (node, path, ...)."""
    carried = [c for c in tops.columns if c not in ("node", "path")]
    known = None
    for nodes in reversed(levels):
        here = nodes.where("size = 1").join(tops, "node")
        if known is not None:
            up = known.select("node", F.col("n").alias("run"), F.col("path").alias("above"), *carried)
            inner = _level(nodes.where("size > 1"), fan_out).join(up, ["node", "run"])
            own = F.array(F.struct("left", "right"))
            here = here.unionByName(inner.withColumn("path", F.concat(own, "above")).select(*here.columns))
        known = here
    return known


def manifest(docs: DataFrame, fields: Sequence[str], *, key: str = "doc_id", source: str = "source",
             also: Mapping[str, Column] | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per input row: key, source, leaf (``record_digest`` of
    ``fields``), path (array of left and right: the siblings on each level up
    to the root, joined left to right), subroot, root, and the columns of
    ``also`` (name -> expression over ``docs``).

    Null source: a tree of its own, before the others. Null key: first.
    Repeated keys: by leaf digest; repeated rows: a leaf each. Null or empty
    values differ by their encoding. One row in all: its leaf is the root and
    its path is empty. Empty table: empty result. Columns not named are not
    looked at.
    """
    empty = F.array().cast("array<struct<left:string,right:string>>")
    rows = stage(
        docs.select(
            F.coalesce(F.concat(F.lit(":"), F.col(source).cast("string")), F.lit("")).alias("node"),
            F.col(key).alias("key"), F.col(source).alias("of_source"), record_digest(*map(F.col, fields)).alias("digest"),
            F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in (also or {}).items()]).alias("also"),
        ),
        "merkle-leaves",
    )
    levels = _levels(stage(_numbered(rows, "node", "key", "digest"), "merkle-numbered"), fan_out)
    subroots = _tops(levels).select(F.lit("").alias("node"), F.col("node").alias("tree"), "digest")
    upper = _levels(stage(_numbered(subroots, "node", "tree"), "merkle-subroots"), fan_out)
    top = _tops(upper).select("node", F.col("digest").alias("root"), empty.alias("path"))
    sources = stage(
        _with_paths(upper, top, fan_out).select(F.col("tree").alias("node"), F.col("digest").alias("subroot"), "root", "path"),
        "merkle-sources",
    )
    out = _with_paths(levels, sources, fan_out)
    return out.select(
        F.col("key").alias(key), F.col("of_source").alias(source), F.col("digest").alias("leaf"), "path", "subroot", "root",
        *[F.col("also")[n].alias(n) for n in (also or {})],
    )
