"""Sums over the subtrees of a forest by centroid decomposition.

A component is split at its centroid: the deepest node whose subtree, inside the component,
has more than half of its weight. What lies at and below the centroid counts for every
node from there up to the top of the component, and these are just the nodes with more than
half of the weight, so no path is walked. Each split halves all components at once, so the rounds
grow with the logarithm of the forest and not with its depth; components of a bounded
weight are decomposed to the end by one task each.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from .sweeps import batched, in_order, runs

#: Weight, so at most nodes, of a component that one task decomposes.
MOST_LOCAL = 1 << 14
#: Heavier components than this are joined to their nodes by a shuffle, fewer are sent to every task.
MOST_SENT = 1 << 16


def local_sums(parents: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Subtree sums of ``values`` in one component whose nodes follow their parents (-1: none in it)."""
    sums = [[0] * len(own) for own in values]
    stack = [list(range(len(parents)))]
    while stack:
        nodes = stack.pop()
        size, below = dict.fromkeys(nodes, 1), {v: values[v] for v in nodes}
        for v in reversed(nodes[1:]):
            p = parents[v]
            size[p] += size[v]
            below[p] = [a + b for a, b in zip(below[p], below[v])]
        path = [v for v in nodes if 2 * size[v] > len(nodes)]
        centroid = path[-1]
        for v in path:
            sums[v] = [a + b for a, b in zip(sums[v], below[centroid])]
        side, parts = {centroid: -1}, defaultdict(list)
        for v in nodes:
            if v == centroid:
                continue
            p = parents[v]
            if v != nodes[0] and p in side:
                side[v] = v if p == centroid else side[p]
            parts[side.get(v, -1)].append(v)
        stack.extend(parts.values())
    return sums


def _finish(state: DataFrame, values: list[str]) -> DataFrame:
    """Sums of components that a task can hold."""
    made = pa.schema([("id", pa.string()), *[(v, pa.int64()) for v in values]])
    k = len(values)

    def answers(batches):
        for _, rows in runs(batches, 1):
            rows = list(rows)
            spot = {r[2]: i for i, r in enumerate(rows)}
            sums = local_sums([spot.get(r[3], -1) for r in rows], [r[4 : 4 + k] for r in rows])
            for r, own in zip(rows, sums):
                yield (r[2], *[a + b for a, b in zip(r[4 + k :], own)])

    def run(batches):
        yield from batched(answers(batches), made)

    columns = state.select("part", "depth", "id", "parent", *values, *[f"_{v}" for v in values])
    return in_order(columns, ["part"], ["depth"]).mapInArrow(run, ", ".join(["id string", *[f"{v} long" for v in values]]))


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], most: int | None = None) -> DataFrame:
    """``(id, *values)``: each node's sums over its subtree, itself included.

    ``nodes`` has id, parent (null at the top), depth, line, weight and the long columns ``values``. ``weight`` is
    the sum over the node's subtree of any positive whole numbers. ``line`` names a row of ancestors: ``steps``
    has (line, depth, id, parent) for every ancestor that a node of that line has, so one equality join
    tells on which side of a centroid a node lies.
    """
    most = most or MOST_LOCAL
    tops = steps.filter("depth = 0").select("line", F.col("id").alias("part"))
    state = nodes.join(tops, "line").select(
        "part", "id", "parent", "depth", "line", F.col("weight").cast("long"),
        *[F.col(v).cast("long").alias(v) for v in values], *[F.lit(0).cast("long").alias(f"_{v}") for v in values],
    )
    columns, ready, state = state.columns, [], cut_lineage(state)
    steps = steps.select("line", F.col("depth").alias("at"), F.col("id").alias("step"), F.col("parent").alias("above"))
    while True:
        totals = cut_lineage(state.groupBy("part").agg(F.max("weight").alias("total")).filter(F.col("total") > most))
        n = totals.count()
        if not n:
            break
        few = F.broadcast if n <= MOST_SENT else (lambda df: df)
        ready.append(state.join(few(totals), "part", "left_anti").select(columns))
        state = state.join(few(totals), "part")
        heavy = state.filter(2 * F.col("weight") > F.col("total"))
        cut = F.min_by(F.struct("id", "depth", "weight"), "weight")
        centroids = cut_lineage(heavy.groupBy("part").agg(cut.alias("cut")).select(
            "part", F.col("cut.id").alias("cut"), F.col("cut.depth").alias("cut_depth"), F.col("cut.weight").alias("cut_weight")))
        state = state.join(few(centroids), "part")
        deep = state.filter("depth > cut_depth").withColumn("at", F.col("cut_depth") + 1)
        deep = deep.join(steps, ["line", "at"]).withColumn("under", F.when(F.col("above") == F.col("cut"), F.col("step"))).drop("at", "step", "above")
        side = cut_lineage(deep.unionByName(state.filter("depth <= cut_depth").withColumn("under", F.lit(None).cast("string"))))
        below = side.filter("under is not null or id = cut").groupBy("part").agg(*[F.sum(v).alias(f"+{v}") for v in values])
        side = side.join(few(cut_lineage(below)), "part")
        over = F.col("under").isNull() & (2 * F.col("weight") > F.col("total"))
        side = side.withColumns({f"_{v}": F.col(f"_{v}") + F.when(over, F.col(f"+{v}")).otherwise(0) for v in values}).withColumns({
            "weight": F.when(over & (F.col("id") != F.col("cut")), F.col("weight") - F.col("cut_weight")).otherwise(F.col("weight")),
            "part": F.coalesce("under", "part"),
        })
        side = cut_lineage(side)
        ready.append(side.filter("id = cut").select(F.concat(F.lit("/"), "id").alias("part"), *[c for c in columns if c != "part"])
                     .withColumns({v: F.lit(0).cast("long") for v in values}))
        state = side.filter("id != cut").select(columns)
    return _finish(reduce(DataFrame.unionAll, ready, state.select(columns)), values)

