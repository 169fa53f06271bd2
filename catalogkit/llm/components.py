"""Connected components of a graph given as edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    spot = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(spot).alias("x"), F.sum(spot % 1_000_003).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _lowest(edges: DataFrame) -> DataFrame:
    """Lowest neighbour of each node, written: the join then shuffles both sides and can split a hub's edges."""
    return cut_lineage(edges.groupBy("a").agg(F.min("b").alias("low")))


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of long ids -> ``(node, component)``, the component being its smallest node.

    Large-star and small-star rounds until the edges are stars. A node's neighbours are
    only reduced to their minimum and joined back, so no neighbourhood is gathered.
    Null ends and loops are left out; nodes without an edge have no row.
    """
    stars = cut_lineage(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = _lowest(both)
        large = (
            both.join(lows, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        )
        lows = _lowest(large)
        small = (
            large.join(lows, "a")
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
            .filter("a != b")
            .distinct()
        )
        stars = cut_lineage(small)
        before, mark = mark, _mark(stars)
        if before == mark:
            break
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes, for one task's edges."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[left], labels[right])
        after = labels.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if np.array_equal(after, labels):
            return labels
        labels = after
