"""Near-duplicate embeddings by int8 tile products with error bounds.

Equal vectors of a label are one class. The classes of a label fall into
tiles, and each pair of tiles is one task group. A unit vector u is kept as
s*q with int8 components q and the residual norm e = |u - s*q|, so that
|u.v - s*t*(q.r)| <= |s*q|*f + e*|t*r| + e*f for any other (t, r, f). Only
pairs whose product plus this bound reaches the threshold are computed again
in double precision. A task group returns a link count and a root per vector,
never the pairs: its output is linear in its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import components, local_roots

TILE = 1024
#: Pairs recomputed at once, and the slack for rounding in the bound itself.
BLOCK, SLACK = 1 << 16, 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, norm of scale*q, norm of the residual) of each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def close_pairs(unit: np.ndarray, rows: np.ndarray, cols: np.ndarray, threshold: float):
    """(i, j) index pairs of rows x cols with cosine >= threshold, i before j if both sides are one tile."""
    q, scale, norm, rest = quantise(unit)
    # products of int8 are whole numbers, exact in float32 up to 2**24
    exact = np.float32 if unit.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = q[cols].astype(exact)
    step = max(1, (1 << 20) // max(1, len(cols)))
    for k in range(0, len(rows), step):
        r = rows[k: k + step]
        at_most = (q[r].astype(exact) @ right.T).astype(np.float64) * scale[r][:, None] * scale[cols]
        at_most += norm[r][:, None] * rest[cols] + rest[r][:, None] * norm[cols] + rest[r][:, None] * rest[cols]
        i, j = np.nonzero(at_most >= threshold - SLACK)
        i, j = r[i], cols[j]
        if rows is cols:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), BLOCK):
            x, y = i[b: b + BLOCK], j[b: b + BLOCK]
            hit = np.einsum("nd,nd->n", unit[x], unit[y]) >= threshold
            yield x[hit], y[hit]


def tile_links(threshold: float):
    """Task of one tile pair: per linked vector its link count (copies of the
    partners) and the class at the root of its links here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cid = table["cid"].to_numpy()
        copies, side = table["copies"].to_numpy(), table["side"].to_numpy()
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(cid), -1)
        x = x / np.abs(x).max(axis=1)[:, None]
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        everything = np.arange(len(cid))
        rows = everything[side == 0]
        cols = rows if table["t0"][0] == table["t1"][0] else everything[side == 1]
        links, left, right = np.zeros(len(cid), np.int64), [], []
        for i, j in close_pairs(unit, rows, cols, threshold):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            left.append(i)
            right.append(j)
        i, j = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
        root = local_roots(len(cid), i, j)
        hit = links > 0
        return pa.table({"cid": cid[hit], "links": links[hit], "root": cid[root][hit]})

    return run


def _usable(vector: Column) -> Column:
    number = vector.cast("array<double>")
    bad = F.exists(number, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(number, lambda c: c != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float, *, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", tile: int = TILE) -> DataFrame:
    """One row per input row: key, n_links (other rows linked directly, copies
    included), component_id (smallest key reachable, itself included), kept.

    Only vectors of one label and one length are compared. A null label or
    vector, a null or non-finite component, or a zero vector links with
    nothing: n_links 0, component_id its own key, kept. Null keys count as
    rows but never as a component's smallest key; a component of null keys
    only keeps all its rows. Repeated rows are copies of one class. Empty
    table: empty result. Other columns are not looked at.
    """
    ok = _usable(F.col(vector)) & F.col(label).isNotNull()
    v = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"), ok.alias("ok"))
    classes = stage(
        v.where("ok").groupBy("label", "vector")
        .agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    tiles = classes.groupBy("label", F.size("vector").alias("dim")).agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")
    )
    placed = classes.withColumn("dim", F.size("vector")).join(tiles, ["label", "dim"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("own", "other").alias("t0"), F.greatest("own", "other").alias("t1"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "copies", "vector",
    )
    found = stage(
        sent.groupBy("label", "dim", "t0", "t1").applyInArrow(tile_links(threshold), "cid long, links long, root long"),
        "tile-links",
    )
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    grouped = classes.select("cid", "first_key").join(roots, F.col("cid") == F.col("node"))
    smallest = grouped.groupBy("root").agg(F.min("first_key").alias("component_id"))
    class_of = grouped.join(smallest, "root").select("cid", "component_id")
    known = (
        classes.join(links, "cid", "left").join(class_of, "cid", "left")
        .select(
            F.col("label").alias("l"), F.col("vector").alias("x"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "first_key").alias("component_id"),
        )
    )
    linked = v.where("ok").join(known, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("x")))
    alone = v.where("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.select("key", "n_links", "component_id").unionAll(alone)
    return out.select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
