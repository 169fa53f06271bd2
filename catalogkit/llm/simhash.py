"""Near-duplicate texts by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from . import texts
from .components import components, local_labels

SHINGLE_WORDS = 4
MAX_DIFFERING_BITS = 4
#: Any two fingerprints with at most four differing bits agree on two of six blocks.
BLOCKS = 6
TILE = 1024


def _prints(words: texts.Words, size: int) -> np.ndarray:
    count = np.diff(words.first)
    starts, per_text = texts.shingle_starts(words, size)
    short = np.flatnonzero((count > 0) & (count < size))
    starts = np.concatenate([starts, words.first[short]])
    last = np.concatenate([starts[: len(starts) - len(short)] + size, words.first[short + 1]]) - 1
    owner = np.concatenate([np.repeat(np.arange(len(count)), per_text), short])
    order = np.argsort(owner, kind="stable")
    starts, last, owner = starts[order], last[order], owner[order]
    out = np.zeros(len(count), np.uint64)
    if not len(starts):
        return out
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], 42) for a, b in zip(words.starts[starts].tolist(), words.ends[last].tolist())),
        np.uint64,
        len(starts),
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    total = np.diff(np.append(cuts, len(owner)))
    out[owner[cuts]] = np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint)`` of whole texts, the fingerprint as a signed long.

    A-Z is lowered; words are parted by ASCII blanks. Each shingle of ``size`` words,
    repeats included, votes with its XXH64 (seed 42); a bit is set by more than half the
    votes. Shorter texts have one shingle; null, empty and blank texts get zero.
    """
    lower = texts.lower_table()
    blank = texts.byte_set(texts.BLANKS)

    def run(batches):
        for batch in texts.slices(batches, "text"):
            prints = _prints(texts.split_words(batch.column("text"), blank, lower), size)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint long"
    )


def masks(blocks: int = BLOCKS, differing: int = MAX_DIFFERING_BITS) -> list[int]:
    """Bit masks of every set of blocks that a close pair may agree on."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(pick) for pick in combinations(own, blocks - differing)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, differing: int = MAX_DIFFERING_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints with few differing bits.

    Fingerprints meet where they agree on a set of blocks. A crowded block value is cut
    into parts and the pairs of parts are the units of work, so none outgrows a task;
    a unit returns each linked fingerprint with the smallest one that it reaches there.
    """
    if not 0 <= differing < blocks:
        raise ValueError("there must be more blocks than differing bits")
    each = [
        F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("value"))
        for i, m in enumerate(masks(blocks, differing))
    ]
    keyed = prints.select("fingerprint", F.explode(F.array(*each)).alias("k")).select("fingerprint", "k.*")
    crowds = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
    crowds = crowds.select("mask", "value", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    met = keyed.join(crowds, ["mask", "value"]).withColumn("part", part)
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "mask", "value", "fingerprint", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        (F.col("part") <= F.col("other")).alias("first"),
    )
    gathered = units.groupBy("mask", "value", "low", "high").agg(
        F.collect_list(F.when(F.col("first"), F.col("fingerprint"))).alias("left"),
        F.collect_list(F.when(~F.col("first"), F.col("fingerprint"))).alias("right"),
    )

    def run(batches):
        for batch in batches:
            found = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                left, right = (x.values.to_numpy(zero_copy_only=False) for x in (left, right))
                nodes = np.sort(np.concatenate([left, right]))
                other = right if len(right) else left
                near = np.bitwise_count((left[:, None] ^ other[None, :]).view(np.uint64)) <= differing
                i, j = np.nonzero(near)
                labels = local_labels(len(nodes), np.searchsorted(nodes, left[i]), np.searchsorted(nodes, other[j]))
                moved = np.flatnonzero(labels != np.arange(len(nodes)))
                found.append(np.stack([nodes[moved], nodes[labels[moved]]]))
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return gathered.select("left", "right").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, differing: int = MAX_DIFFERING_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    The fingerprint is 16 lowercase hex digits; ``component_id`` is the smallest doc_id
    that links reach. Rows without a doc_id are answered too and never name a component,
    unless no row of it has one (then it is null). Other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, size))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low_id"))
    found = components(links(distinct.select("fingerprint"), differing))
    placed = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    # Written, so that a large component can be split when it is joined back.
    named = cut_lineage(placed.groupBy("component").agg(F.min("low_id").alias("component_id")))
    groups = placed.join(named, "component").select("fingerprint", "component_id")
    return prints.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
