"""Exact pairs of embeddings above a cosine threshold by dual traversal of cover trees.

On unit vectors a cosine is a distance: ``d * d = 2 - 2 * cos``. Vectors are dealt to cells
around a few far-apart centres and cells to blocks of bounded size. Each block
has a cover tree: nested nets whose radii halve from level to level, each node with the
exact radius that covers its vectors. Two blocks are traversed together: a pair of nodes
farther apart than the threshold plus both radii holds no link and is dropped; a pair closer
than the threshold less both radii links all its vectors at once, so a crowd of near
copies is settled by a few nodes; the rest is split, down to single cosines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogkit.session import cut_lineage

from .components import components, local_labels

THRESHOLD = 0.9
BLOCK = 3072
#: Vectors that the centres are chosen from, and at most so many cells.
SAMPLE, MOST_CELLS, CELL_ROWS = 2048, 64, 8192
LEVELS = 6
TILE = 1024
_CHUNK = 1 << 15
#: What a product of unit vectors in single precision may be off by, and more.
_SINGLE = 1e-4
#: Distances come from rounded products; bounds keep this much apart from the threshold.
SLACK = 1e-6


def unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1)
    return scaled(x)


def scaled(x: np.ndarray) -> np.ndarray:
    # The largest entry goes first, so that no square over- or underflows.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def centres(x: np.ndarray, most: int, stop: float) -> np.ndarray:
    """Rows far apart from each other: each next one is the farthest from those before."""
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < most and near.max() > stop:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Tree:
    """Nested nets over unit vectors, which are put in an order that makes every node a range.

    ``nodes[level]`` is (place of the centre, begin, end, covering radius, first child) of
    its nodes; the children of a node are those from its first child to the next node's.
    """

    def __init__(self, x: np.ndarray, widest: float, order: np.ndarray | None = None, nodes: list | None = None):
        self.order, self.nodes = (order, nodes) if nodes is not None else self._build(x, widest)
        self.x = x[self.order] if order is None else x

    @staticmethod
    def _build(x: np.ndarray, widest: float) -> tuple[np.ndarray, list]:
        chosen, radius = [0], widest
        near = x @ x[0]  # cosine to the nearest centre
        near[0] = 1
        nets = [np.array([0])]
        while len(nets) < LEVELS and len(chosen) < len(x):
            least = 1 - radius * radius / 2
            for i in range(len(x)):
                if near[i] < least:
                    chosen.append(i)
                    np.maximum(near, x @ x[i], out=near)
                    near[i] = 1
            nets.append(np.array(chosen))
            radius /= 2
        below = np.arange(len(x))  # place in the finest net, then in each coarser one
        above = []
        for net in reversed(nets):
            nearest = [(x[below[a : a + TILE]] @ x[net].T).argmax(1) for a in range(0, len(below), TILE)]
            above.append(np.concatenate(nearest))
            below = net
        place, chains = np.arange(len(x)), []
        for nearest in above:
            place = nearest[place]
            chains.append(place)
        chains.reverse()
        order = np.lexsort(chains[::-1])
        sorted_x, at = x[order], np.empty(len(x), np.int64)
        at[order] = np.arange(len(x))
        nodes, begins = [], []
        for net, chain in zip(nets, chains):
            own = chain[order]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            end = np.append(begin[1:], len(x))
            mid = np.repeat(x[net[own[begin]]], end - begin, axis=0)
            far = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", sorted_x, mid), 0))
            # A copy of its centre has distance zero, whatever rounding says.
            far[(sorted_x == mid).all(axis=1)] = 0
            nodes.append([at[net[own[begin]]], begin, end, np.maximum.reduceat(far, begin)])
            begins.append(begin)
        for node, begin, under in zip(nodes, begins, [*begins[1:], begins[-1]]):
            node.append(np.searchsorted(under, begin))
        return order, [tuple(n) for n in nodes]

    def level(self, depth: int):
        return self.nodes[min(depth, len(self.nodes) - 1)]

    def children(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child one level down of some nodes, and how many there are; a last level is its own child."""
        if depth + 1 >= len(self.nodes):
            return nodes, np.ones(len(nodes), np.int64)
        first = self.nodes[depth][4]
        last = np.append(first[1:], len(self.nodes[depth + 1][0]))
        return first[nodes], last[nodes] - first[nodes]


def _apart(xa: np.ndarray, i: np.ndarray, xb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows."""
    cos = [np.einsum("ij,ij->i", xa[i[k : k + _CHUNK]], xb[j[k : k + _CHUNK]]) for k in range(0, len(i), _CHUNK)]
    return np.sqrt(np.maximum(2 - 2 * np.concatenate([np.zeros(0), *cos]), 0))


def _reaching(xa, ra, xb, rb, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes not farther apart than the limit and both radii, and their distance.

    Nodes without extent and others are looked at apart, so that few wide nodes do not
    keep the bound of all others loose.
    """
    found = []
    for rows in (np.flatnonzero(ra == 0), np.flatnonzero(ra > 0)):
        for cols in (np.flatnonzero(rb == 0), np.flatnonzero(rb > 0)):
            if not len(rows) or not len(cols):
                continue
            other, most = xb[cols].astype(np.float32).T, rb[cols].max()
            for at in range(0, len(rows), TILE):
                own = rows[at : at + TILE]
                # Single precision finds all that could reach; their distances are then taken in double.
                least = 1 - np.minimum(limit + ra[own] + most + SLACK, 2) ** 2 / 2 - _SINGLE
                i, j = np.nonzero(xa[own].astype(np.float32) @ other >= least[:, None].astype(np.float32))
                i, j = own[i], cols[j]
                d = _apart(xa, i, xb, j)
                kept = d <= limit + ra[i] + rb[j] + SLACK
                found.append((i[kept], j[kept], d[kept]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def widest_net(threshold: float) -> float:
    """Radius below the root: twice the distance of a link, as wider nodes hold too many strangers to be dropped whole."""
    return 2 * float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def linked(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Links between two trees: rows (begin, end, begin, end) of ranges that link as a whole, and pairs of single vectors."""
    limit = np.sqrt(max(0.0, 2 - 2 * threshold))
    ranges, left, right = [np.zeros((4, 0), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i = j = np.zeros(1, np.int64)  # pairs of nodes still open
    depth = max(len(a.nodes), len(b.nodes))
    for level in range(depth):
        (ca, ba, ea, ra, _), (cb, bb, eb, rb, _) = a.level(level), b.level(level)
        if level:
            (fi, ni), (fj, nj) = a.children(level - 1, i), b.children(level - 1, j)
            if (ni * nj).sum() > 0.05 * len(ca) * len(cb):
                # Nearly all pairs are open: all are measured, those below closed pairs dropped.
                spans = list(zip(fi.tolist(), ni.tolist(), fj.tolist(), nj.tolist()))
                i, j, d = _reaching(a.x[ca], ra, b.x[cb], rb, limit)
                if len(spans) > 1:
                    open_ = np.zeros((len(ca), len(cb)), bool)
                    for p, n, q, m in spans:
                        open_[p : p + n, q : q + m] = True
                    kept = open_[i, j]
                    i, j, d = i[kept], j[kept], d[kept]
            else:
                pair = np.repeat(np.arange(len(i)), ni * nj)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(ni * nj) - ni * nj, ni * nj)
                i, j = fi[pair] + place // nj[pair], fj[pair] + place % nj[pair]
                d = _apart(a.x, ca[i], b.x, cb[j])
                kept = d <= limit + ra[i] + rb[j] + SLACK
                i, j, d = i[kept], j[kept], d[kept]
        else:
            d = distances(a.x[ca], b.x[cb])[0]
        whole = d + ra[i] + rb[j] <= limit - SLACK
        ranges.append(np.stack([ba[i[whole]], ea[i[whole]], bb[j[whole]], eb[j[whole]]]))
        i, j = i[~whole], j[~whole]
        if not len(i):
            break
    if len(i):
        (_, ba, ea, _, _), (_, bb, eb, _, _) = a.nodes[-1], b.nodes[-1]
        for k, m in zip(i.tolist(), j.tolist()):
            for at in range(ba[k], ea[k], TILE):
                near = a.x[at : min(at + TILE, ea[k])] @ b.x[bb[m] : eb[m]].T >= threshold
                p, q = np.nonzero(near)
                left.append(p + at)
                right.append(q + bb[m])
    ranges = np.concatenate(ranges, axis=1)
    single = (ranges[1] - ranges[0] == 1) & (ranges[3] - ranges[2] == 1)
    left.append(ranges[0, single])
    right.append(ranges[2, single])
    return ranges[:, ~single].T, (np.concatenate(left), np.concatenate(right))


_BLOCK = "size int, cell int, part int, rep array<long>, copies array<long>, vectors binary, sizes array<int>, nodes binary, radii binary"


def _stored(table: pa.Table, kind: str, threshold: float) -> pa.Table:
    """A block with its tree, from the rows of the block."""
    raw = table.column("vector").to_pylist()
    tree = Tree(unit(raw, kind), widest_net(threshold))
    order = tree.order.tolist()
    nodes = np.concatenate([np.stack([n[0], n[1], n[2], n[4]]) for n in tree.nodes], axis=1)
    return pa.table(
        {
            "size": table.column("size").slice(0, 1), "cell": table.column("cell").slice(0, 1), "part": table.column("part").slice(0, 1),
            "rep": pa.array([table.column("rep").take(order).to_pylist()], pa.list_(pa.int64())),
            "copies": pa.array([table.column("copies").take(order).to_pylist()], pa.list_(pa.int64())),
            "vectors": pa.array([b"".join(raw[i] for i in order)], pa.binary()),
            "sizes": pa.array([[len(n[0]) for n in tree.nodes]], pa.list_(pa.int32())),
            "nodes": pa.array([nodes.astype(np.int32).tobytes()], pa.binary()),
            "radii": pa.array([np.concatenate([n[3] for n in tree.nodes]).tobytes()], pa.binary()),
        }
    )


def _restored(row: dict, kind: str) -> tuple[Tree, np.ndarray, np.ndarray]:
    x = scaled(np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(len(row["rep"]), -1))
    whole, radii, at, nodes = np.frombuffer(row["nodes"], np.int32).reshape(4, -1).astype(np.int64), np.frombuffer(row["radii"]), 0, []
    for n in row["sizes"]:
        centre, begin, end, child = whole[:, at : at + n]
        nodes.append((centre, begin, end, radii[at : at + n], child))
        at += n
    return Tree(x, 0.0, np.arange(len(x)), nodes), np.array(row["rep"], np.int64), np.array(row["copies"], np.int64)


def _settle(blocks: list[dict], kind: str, threshold: float) -> dict:
    """Links found between two blocks, or inside one: per vector how many, and the lowest one reached here."""
    trees, b = [_restored(row, kind) for row in blocks], len(blocks) > 1
    (ta, ids_a, n_a), (tb, ids_b, n_b) = trees[0], trees[-1]
    ranges, (left, right) = linked(ta, tb, threshold)
    total_a, total_b = np.bincount(left, weights=n_b[right], minlength=len(n_a)), np.bincount(right, weights=n_a[left], minlength=len(n_b))
    sum_a, sum_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    shift = len(n_a) if b else 0
    edges = [(left, right + shift)]
    for p, q, r, s in ranges.tolist():
        total_a[p:q] += sum_b[s] - sum_b[r]
        total_b[r:s] += sum_a[q] - sum_a[p]
        edges += [(np.arange(p, q), np.full(q - p, r + shift)), (np.full(s - r, p), np.arange(r, s) + shift)]
    ids, total = (np.append(ids_a, ids_b), np.append(total_a, total_b)) if b else (ids_a, total_a)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    u, v = (np.concatenate(x) for x in zip(*edges))
    labels = local_labels(len(ids), rank[u], rank[v])
    reached = ids[order][labels][rank]
    shown = np.flatnonzero(total > 0)
    return {"rep": ids[shown], "n": total[shown].astype(np.int64), "low": reached[shown]}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vec_id`` and ``embedding``.

    Vectors link at a cosine, in double precision, of at least the threshold (above 0.5).
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    vec_id that links reach. Null, empty and zero vectors and those with null or non-finite
    entries link with nothing, nor do vectors of different lengths or rows without a
    vec_id; the latter have a null component and are not kept. Copies are compared as one
    vector. Other columns are ignored.
    """
    if not 0.5 < threshold < 1:
        raise ValueError("the threshold lies between 0.5 and 1")
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    item = "float" if single else "double"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(item)))
    filled = sound & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()

    def packed(batches):
        for batch in batches:
            column = batch.column("embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # -0 and 0 are one value
            cuts = np.append(0, np.cumsum([len(x) for x in column])) * flat.itemsize
            data = flat.astype(kind).tobytes()
            rows = [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.record_batch([batch.column("vec_id"), pa.array(rows, pa.binary())], ["vec_id", "vector"])

    members = cut_lineage(given.filter(filled).mapInArrow(packed, "vec_id long, vector binary"))
    distinct = cut_lineage(members.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = distinct.count()
    cells = max(1, min(MOST_CELLS, n // CELL_ROWS))
    sample: dict[int, list[bytes]] = {}
    for row in distinct.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).collect():
        sample.setdefault(len(row["vector"]), []).append(bytes(row["vector"]))
    mids = {size: centres(unit(rows, kind), cells, 2 * (1 - threshold)) for size, rows in sample.items()}

    def dealt(batches):
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            sizes = np.array([len(r) for r in rows])
            cell, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                if size in mids:
                    d = distances(unit([rows[i] for i in own], kind), mids[size])
                    cell[own], far[own] = d.argmin(1), d.min(1)
                else:  # a length that the sample lacks has one cell that reaches everywhere
                    far[own] = 2.0
            columns = [batch.column("rep"), batch.column("copies"), batch.column("vector"), pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(far)]
            yield pa.record_batch(columns, ["rep", "copies", "vector", "size", "cell", "far"])

    placed = cut_lineage(distinct.mapInArrow(dealt, "rep long, copies long, vector binary, size int, cell int, far double"))
    # At most MOST_CELLS rows for each length of vectors.
    found = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    limit = float(np.sqrt(2 - 2 * threshold))
    layout = []
    for c in found:
        met = []
        for d in found:
            if c["size"] == d["size"]:
                m = mids.get(c["size"])
                apart = float(distances(m[c["cell"]][None], m[d["cell"]][None])[0, 0]) if m is not None else 0.0
                if apart <= c["far"] + d["far"] + limit + SLACK:
                    met.append((d["cell"], -(-d["n"] // BLOCK)))
        layout.append((c["size"], c["cell"], -(-c["n"] // BLOCK), met))
    spark = vectors.sparkSession
    plan = spark.createDataFrame(layout, "size int, cell int, parts int, met array<struct<cell: int, parts: int>>")
    parted = placed.join(F.broadcast(plan.select("size", "cell", "parts")), ["size", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    )
    chosen = parted.select("size", "cell", "part", "rep", "copies", "vector").groupBy("size", "cell", "part")
    # Trees are built once and meet every block that they may have links with.
    blocks = chosen.applyInArrow(lambda table: _stored(table, kind, threshold), _BLOCK)
    carried = ["rep", "copies", "vectors", "sizes", "nodes", "radii"]
    own = F.struct("cell", "part")
    partner = F.explode(F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.lit(0), m["parts"] - 1), lambda q: F.struct(m["cell"].alias("cell"), q.alias("part"))))))
    pairs = blocks.join(F.broadcast(plan.drop("parts")), ["size", "cell"]).select("size", *carried, own.alias("own"), partner.alias("partner"))
    pairs = pairs.select("size", *carried, F.least("own", "partner").alias("a"), F.greatest("own", "partner").alias("b"), (F.col("own") <= F.col("partner")).alias("first"))

    def run(table: pa.Table) -> pa.Table:
        return pa.table(_settle(table.sort_by([("first", "descending")]).select(carried).to_pylist(), kind, threshold))

    links = cut_lineage(pairs.groupBy("size", "a", "b").applyInArrow(run, "rep long, n long, low long"))
    graph = components(links.filter("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = distinct.select("vector", "rep").join(counts, "rep").join(graph.withColumnRenamed("node", "rep"), "rep", "left")
    settled = members.join(named, "vector").select("vec_id", (F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    loose = given.filter(~F.coalesce(filled, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return settled.unionAll(loose).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
