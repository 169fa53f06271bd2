"""The trie of conversation prefixes, with what sharing them saves."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from .sweeps import batched, in_order, numbered, runs
from .tree_sums import subtree_sums

#: Conversations of a block begin like its first one; by how many turns, the remainder of a checksum tells.
BLOCK, MOST_SHARED = 100, 6
#: Characters of a list of ids that travel as one row.
LIST_CHARS = 1 << 16

ROOT = "0" * 32


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv, place, size, key, chars)``: turns in order, with a digest of role and text instead of both.

    Null role and text are empty, a null turn comes first, equal turns go by their digest. Rows without a
    conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"),
        F.length(text).cast("long").alias("chars"),
    )
    return cut_lineage(numbered(given, ["conv"], ["turn", "key"]).select("conv", "place", "size", "key", "chars"))


def rebuilt(conversations: DataFrame, block: int = BLOCK, most: int = MOST_SHARED) -> DataFrame:
    """``(conv, depth, turns, key, chars)``: conversations that begin as the first one of their block does.

    The row of depth 0 stands for the conversation itself, also where it has no turns left.
    """
    own = turns(conversations)
    first = own.filter((F.col("conv") % block == 0) & (F.col("place") < most))
    held = first.filter("place = 0").select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = own.filter("place = 0").select(
        "conv", F.col("size").alias("own_size"), (F.col("conv") - F.col("conv") % block).alias("base"),
        (F.crc32(F.col("conv").cast("string")) % most).alias("taken"),
    ).join(held, "base", "left")
    given = F.least("taken", F.coalesce("base_size", F.lit(0)))
    convs = cut_lineage(convs.select(
        "conv", "base", "taken", given.alias("given"), (given + F.greatest(F.col("own_size") - F.col("taken"), F.lit(0))).alias("turns")))
    tops = convs.select("conv", F.lit(0).cast("long").alias("depth"), "turns", F.lit("").alias("key"), F.lit(0).cast("long").alias("chars"))
    start = convs.join(first.withColumnRenamed("conv", "base"), "base").filter("place < taken")
    start = start.select("conv", (F.col("place") + 1).alias("depth"), "turns", "key", "chars")
    rest = own.join(convs, "conv").filter("place >= taken")
    rest = rest.select("conv", (F.col("given") + F.col("place") - F.col("taken") + 1).alias("depth"), "turns", "key", "chars")
    return tops.unionAll(start).unionAll(rest)


def prefixes(turns_of: DataFrame) -> DataFrame:
    """``(conv, depth, turns, chars, id, parent)``: the prefix that each turn ends, and the one before it.

    An id is 128 bits of exclusive or over hashes of (depth, turn). That is associative, so what a
    partition holds of a conversation is added up first and no conversation needs to be in one task.
    """
    marks = {f"x{k}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "key")).otherwise(0) for k in range(2)}
    rows = cut_lineage(turns_of.withColumns(marks).drop("key"))
    laid = cut_lineage(rows.repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth"))
    laid = laid.withColumn("part", F.spark_partition_id())
    held = laid.groupBy("conv", "part").agg(*[F.bit_xor(x).alias(x) for x in marks])
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("conv", "part", *[F.coalesce(F.bit_xor(x).over(ahead), F.lit(0)).alias(f"before_{x}") for x in marks])
    # Most conversations lie in one partition: only others have something ahead.
    held = cut_lineage(held.filter("before_x0 != 0 or before_x1 != 0"))
    laid = cut_lineage(laid.join(held, ["conv", "part"], "left").sortWithinPartitions("conv", "depth")) if not held.isEmpty() else laid

    names = ["conv", "depth", "turns", "chars", "a", "b", "above_a", "above_b"]

    def run(batches):
        last, carried = (None, None), [np.int64(0)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {name: batch.column(name).fill_null(0).to_numpy().astype(np.int64) for name in batch.schema.names}
            conv, part = own["conv"], own["part"]
            new = np.append((conv[0], part[0]) != last, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1]))
            starts, sums, above = np.flatnonzero(new), [], []
            for k in range(2):
                x = own[f"x{k}"]
                total, base = np.bitwise_xor.accumulate(x), np.full(len(x), carried[k])
                if len(starts):
                    before = total[starts] ^ x[starts] ^ own.get(f"before_x{k}", np.zeros_like(x))[starts]
                    base[starts[0] :] = np.repeat(before, np.diff(np.append(starts, len(x))))
                sums.append(total ^ base)
                above.append(sums[-1] ^ x)
            last, carried = (conv[-1], part[-1]), [s[-1] for s in sums]
            yield pa.record_batch([batch.column(c) for c in names[:4]] + [pa.array(s) for s in sums + above], names)

    found = laid.mapInArrow(run, ", ".join(f"{name} long" for name in names))
    text = lambda a, b: F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))
    return cut_lineage(found.select(
        "conv", "depth", "turns", "chars", text("a", "b").alias("id"), F.when(F.col("depth") > 0, text("above_a", "above_b")).alias("parent")))


def ends(steps: DataFrame) -> DataFrame:
    """``(id, ends_sha256)`` of nodes at which conversations end: their ids in order, joined by commas.

    Lists are joined by ranges of (node, id) first, so the task that adds up a digest reads a few long strings
    even where a third of all conversations end at one node.
    """
    listed = pa.schema([("id", pa.string()), ("first", pa.int64()), ("list", pa.string())])
    made = pa.schema([("id", pa.string()), ("ends_sha256", pa.string())])

    def lists(batches):
        def own():
            for (node,), rows in runs(batches, 1):
                held, size, first = [], 0, None
                for _, conv in rows:
                    first = conv if first is None else first
                    held.append(str(conv))
                    size += len(held[-1]) + 1
                    if size > LIST_CHARS:
                        yield node, first, ",".join(held)
                        held, size, first = [], 0, None
                if held:
                    yield node, first, ",".join(held)

        yield from batched(own(), listed, 256)

    def digests(batches):
        def own():
            for (node,), rows in runs(batches, 1):
                state = sha256()
                for k, (_, _, part) in enumerate(rows):
                    state.update(("," * (k > 0) + part).encode())
                yield node, state.hexdigest()

        yield from batched(own(), made)

    last = cut_lineage(steps.filter("depth = turns").select("id", "conv"))
    laid = last.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv").mapInArrow(lists, "id string, first long, list string")
    return in_order(laid, ["id"], ["first"]).mapInArrow(digests, "id string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the textless root down.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: conv_id is the
    smallest of the n_convs members; n_leaves and saved_tokens are sums over the subtree, by centroid
    decomposition. Conversations without turns are members of the root. An empty table has no
    root and no rows.
    """
    steps = prefixes(rebuilt(conversations))
    nodes = cut_lineage(steps.groupBy("id").agg(
        F.min("conv").alias("line"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.any_value("chars").alias("chars"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
    ))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}))
    sums = subtree_sums(nodes, steps.select(F.col("conv").alias("line"), "depth", "id", "parent"), ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("id").alias("parent"), F.col("line").alias("parent_conv_id"))
    found = nodes.drop("n_leaves", "saved_tokens").join(sums, "id").join(ends(steps), "id", "left").join(above, "parent", "left")
    return found.select(
        F.col("line").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )
