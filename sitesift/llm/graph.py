"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes along the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``, both long: root is the
    smallest node of its component, and a root is listed as its own.

    Each round hangs the larger neighbours of every node, then the node and
    its smaller neighbours, under the smallest neighbour, until each
    component is one star. Minima are combined map-side and staged, so that
    their joins are plain equi-joins, whose partition of a node with very many
    links Spark splits. Links to itself and repeated links do no harm.
    """
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-star")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
