"""A Merkle manifest of a dataset, by time-forward processing of its trees.

Nodes are handled in the order of their labels (level, place). A digest is a message to the
label of the parent; the queue that delivers it is a heap while the parent lies in the same
block of ``SPAN`` nodes, and a sorted table between blocks. A second sweep goes through the
labels in reverse and delivers proofs from parents to children.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from .sweeps import batched, in_order, numbered, runs

WAYS = 8
#: Levels of a tree that one sweep handles; a block has at most WAYS ** LEVELS nodes.
LEVELS = 3
SPAN = WAYS**LEVELS
#: Rows whose crc32(doc_id) this divides are tampered with, to see their proofs fail.
TAMPERED_EVERY = 3

_TREE = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
_PATH = pa.schema([("places", pa.string()), ("sizes", pa.string()), ("others", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
_PATH_DDL = "places string, sizes string, others string, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value behind its length, so that no two rows read the same; ``-`` for null."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame, every: int = TAMPERED_EVERY) -> DataFrame:
    """``(doc_id, tree, digest, changed)``: leaf of each row, and that of the row with tampered text.

    Trees are named so that they sort by lang, null first. A null doc_id is not tampered with.
    """
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = F.concat(*[field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")])
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % every == 0
    lang = F.col("lang").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"),
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("tree"),
        F.sha2(F.concat(head, field(text)), 256).alias("digest"),
        F.when(hit, F.sha2(F.concat(head, field(lower)), 256)).alias("changed"),
    )


def steps(size: int, most: int = LEVELS) -> int:
    """Levels above ``size`` nodes until one is left, at most ``most``."""
    n = 0
    while size > 1 and n < most:
        size, n = -(-size // WAYS), n + 1
    return n


class Block:
    """Nodes of consecutive places and all that is above them within some levels."""

    def __init__(self, first: int, nodes: list[str], levels: int):
        self.levels, self.first = levels, first
        self.digests: dict[tuple[int, int], str] = {}
        queue = [(0, first + k, node) for k, node in enumerate(nodes)]
        heapq.heapify(queue)
        while queue:
            level, place, node = heapq.heappop(queue)
            self.digests[level, place] = node
            if level == levels:
                self.top = (level, place)
                continue
            run = [node]
            while queue and queue[0][0] == level and queue[0][1] // WAYS == place // WAYS:
                _, at, other = heapq.heappop(queue)
                self.digests[level, at] = other
                run.append(other)
            heapq.heappush(queue, (level + 1, place // WAYS, digest("".join(run))))

    def proofs(self, above: tuple[str, str, str]) -> Iterator[tuple[int, tuple[str, str, str]]]:
        """Place and (place in each run, size of each run, siblings) of every node at the bottom."""
        queue = [(-self.top[0], -self.top[1], above)]
        while queue:
            level, place, (places, sizes, others) = heapq.heappop(queue)
            level, place = -level, -place
            if level == 0:
                yield place, (places, sizes, others)
                continue
            run = [at for at in range(place * WAYS, place * WAYS + WAYS) if (level - 1, at) in self.digests]
            own = [self.digests[level - 1, at] for at in run]
            for k, at in enumerate(run):
                path = (f"{k}{places}", f"{len(run)}{sizes}", "".join(own[:k] + own[k + 1 :]) + others)
                heapq.heappush(queue, (1 - level, -at, path))


def folded(leaf: str, places: str, sizes: str, others: str) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    for place, size in zip(map(int, places), map(int, sizes)):
        width = len(leaf)
        left, right = others[at : at + place * width], others[at + place * width : at + (size - 1) * width]
        leaf, at = digest(left + leaf + right), at + (size - 1) * width
    return leaf


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / SPAN).cast("long"))


def _climb(nodes: DataFrame) -> DataFrame:
    """``(tree, place, size, digest)`` of the tops of all blocks, each a node of the next round."""

    def run(batches):
        def tops():
            for (tree, block), rows in runs(batches, 2):
                rows = list(rows)
                size = rows[0][3]
                levels = steps(size)
                made = Block(rows[0][2], [r[4] for r in rows], levels)
                yield tree, block if levels else rows[0][2], -(-size // WAYS**levels), made.digests[made.top]

        yield from batched(tops(), _TREE)

    dealt = in_order(_blocks(nodes).select("tree", "block", "place", "size", "digest"), ["tree", "block"], ["place"])
    return cut_lineage(dealt.mapInArrow(run, "tree string, place long, size long, digest string"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of each round, from ``(tree, place, size, digest)`` up to the tops of all trees."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(_climb(rounds[-1].select(*_TREE.names)))
    return rounds


def _descend(nodes: DataFrame, paths: DataFrame, finish: bool) -> DataFrame:
    """Paths of all nodes from those of the tops of their blocks.

    ``finish`` gives, instead of paths, what a document is told: its proof's digest and the fold.
    """
    kept = ["doc_id", "changed"] if finish else []
    if finish:
        made = pa.schema(
            [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
        )
        ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    else:
        made = pa.schema([_TREE.field("tree"), _TREE.field("place"), *_PATH])
        ddl = f"tree string, place long, {_PATH_DDL}"

    def answers(batches):
        for (tree, _), rows in runs(batches, 2):
            path = next(rows)[6:11]
            rows = list(rows)
            block = Block(rows[0][3], [r[5] for r in rows], steps(rows[0][4]))
            own = {r[3]: r for r in rows}
            for place, (places, sizes, others) in block.proofs(path[:3]):
                subroot, root = path[3:]
                if not finish:
                    yield tree, place, places, sizes, others, subroot, root
                    continue
                leaf, doc_id, changed = own[place][5], *own[place][11:]
                back = folded(changed or leaf, places, sizes, others)
                yield doc_id, leaf, subroot, root, digest(others), back, back == root

    def run(batches):
        yield from batched(answers(batches), made, 512)

    nothing = [F.lit(None).cast("string").alias(c) for c in _PATH.names]
    below = _blocks(nodes).select("tree", "block", F.lit(1).alias("kind"), "place", "size", "digest", *nothing, *kept)
    above = paths.select(
        "tree", F.col("place").alias("block"), F.lit(0).alias("kind"), "place", F.lit(0).cast("long").alias("size"),
        F.lit("").alias("digest"), *_PATH.names,
        *([F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed")] if finish else []),
    )
    return in_order(below.unionAll(above), ["tree", "block"], ["kind", "place"]).mapInArrow(run, ddl)


def _down(rounds: list[DataFrame], paths: DataFrame, finish: bool) -> DataFrame:
    """Paths of the first round's nodes from those of the last round's."""
    for nodes in reversed(rounds[1:-1]):
        paths = cut_lineage(_descend(nodes, paths, False))
    return _descend(rounds[0], paths, finish)


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each behind its byte count. The
    leaves of a lang ascend by doc_id (null first; rows that share it by their digest); every
    eight consecutive nodes become their digest until one is left. These subroots, by lang with
    null first, give the root the same way. ``folded_root`` comes from the proof and the leaf of
    the row as it would be tampered with, so it equals the root only where that changes nothing.
    Repeated rows are leaves of their own; an empty table has no rows and no root.

    No tree is held by a task: sweeps handle blocks of 512 nodes, and a round goes through all
    blocks of all trees, so a lang that has most rows is dealt out like the others.
    """
    lowest = numbered(leaves(docs), ["tree"], ["doc_id", "digest", "changed"])
    rounds = climb(cut_lineage(lowest))
    subroots = rounds[-1].select(F.lit("").alias("all"), F.col("tree").alias("lang"), F.col("digest"))
    subroots = cut_lineage(numbered(subroots, ["all"], ["lang"]).withColumnRenamed("all", "tree"))
    tops = climb(subroots)
    nothing = [F.lit("").alias(c) for c in ("places", "sizes", "others", "subroot")]
    path = tops[-1].select("tree", "place", *nothing, F.col("digest").alias("root"))
    if len(tops) > 1:
        path = cut_lineage(_down(tops, path, False))
    known = subroots.select("tree", "place", "lang", F.col("digest").alias("_own"))
    path = known.join(path, ["tree", "place"]).select(
        F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), "places", "sizes", "others", F.col("_own").alias("subroot"), "root"
    )
    return _down(rounds, cut_lineage(path), True)
