"""Removal of repeated word windows, counted exactly by super-k-mer partitioning.

1. Whole rows form blocks of a few MB. Consecutive windows of a text that share their
   minimiser (the lowest hash of three neighbouring words) make one super-k-mer, packed as
   one string. Equal strings of a block travel once, with the block's lowest and highest
   doc_id that have them, to the bucket of the minimiser.
2. A bucket holds every window of its minimisers. Sorting its windows gives the lowest
   doc_id of each; blocks are told the windows that a lower document has.
3. A block meets its answers again and drops the covered words.

A block and a bucket's share of a block are bounded, and a group of copies shrinks to a
string per block before it moves, so no key gathers its rows. The block itself moves
once more instead of being read and split again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import texts

WINDOW = 13
#: Words of a minimiser: two would be common enough to crowd a bucket, more make shorter runs.
MINIMISER = 3
#: A longer run of windows (a word repeated over and over) is cut; its parts share the bucket.
MOST_WINDOWS = 64
BUCKETS_PER_PARTITION = 4
#: Compression of what moves.
LEVEL = 6
_LAST = np.iinfo(np.int64).max
_MOVED = "block long, key long, n int, raw long, body binary"


def _pack(*parts: np.ndarray | bytes) -> tuple[int, bytes]:
    whole = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return len(whole), pa.Codec("zstd", compression_level=LEVEL).compress(whole, asbytes=True)


def _unpack(raw: int, body: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, raw, codec="zstd", asbytes=True), np.uint8)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, which take less room when values rise slowly; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def _lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    step = 1
    while 2 * step <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (size - step)], values[size - step :]) if step < size else values


def super_kmers(words: texts.Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer."""
    starts, counts = texts.shingle_starts(words, window)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    marks = np.zeros(len(hashes) - MINIMISER + 1, np.uint64)
    for i in range(MINIMISER):
        marks = marks * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(marks) + i]
    low = _lowest(texts.mix(marks), window - MINIMISER + 1)[starts]
    owner = np.repeat(np.arange(len(counts)), counts)
    new = np.append(True, (np.diff(owner) != 0) | (low[1:] != low[:-1]))
    begun = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(begun, np.diff(np.append(begun, len(starts))))
    begun = np.flatnonzero(place % MOST_WINDOWS == 0)
    return starts[begun], np.diff(np.append(begun, len(starts))), low[begun]


def _same_runs(numbers: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the runs of words at ``left`` and ``right`` are equal."""
    same = numbers[texts.spread_out(left, sizes)] == numbers[texts.spread_out(right, sizes)]
    return np.logical_and.reduceat(same, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, bool)


def _distinct_runs(numbers, hashes, first, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Index of one run per distinct run of words, and for each run which of those it equals."""
    _, chosen, which = np.unique(
        texts.hash_runs(hashes, first, first + sizes), return_index=True, return_inverse=True
    )
    other = np.flatnonzero((chosen[which] != np.arange(len(first))))
    like = chosen[which[other]]
    equal = sizes[other] == sizes[like]
    equal[equal] = _same_runs(numbers, first[other[equal]], first[like[equal]], sizes[other[equal]])
    odd = other[~equal]
    which[odd] = len(chosen) + np.arange(len(odd))
    return np.append(chosen, odd), which


def _split(batches, window: int, buckets: int):
    """Blocks (key below zero) and what each sends to the buckets."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in texts.slices(batches, "text"):
        block = (task << 32) | made
        made += 1
        words = texts.split_words(batch.column("text"))
        numbers, hashes = words.hashes()
        first, windows, low = super_kmers(words, hashes, window)
        sizes = windows + window - 1
        chosen, which = _distinct_runs(numbers, hashes, first, sizes)
        bucket = (low[chosen] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((first[chosen], bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chosen, bucket, which = chosen[order], bucket[order], place[which]
        ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
        own = ids[words.text_of[first]] if len(first) else np.zeros(0, np.int64)
        lowest, highest = np.full(len(chosen), _LAST), np.full(len(chosen), np.iinfo(np.int64).min)
        np.minimum.at(lowest, which, own)
        np.maximum.at(highest, which, own)
        begin, end = words.starts[first[chosen]].tolist(), (words.ends[first[chosen] + sizes[chosen] - 1] + 1).tolist()
        data, count = words.data.tobytes(), sizes[chosen].astype(np.uint8)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        rows = {name: [] for name in ("block", "key", "n", "raw", "body")}

        def add(*row):
            for name, value in zip(rows, row):
                rows[name].append(value)

        for a, b in zip(cuts, [*cuts[1:], len(chosen)]):
            packed = b"".join([data[x:y] for x, y in zip(begin[a:b], end[a:b])])
            size, body = _pack(np.int64(a).tobytes(), _steps(lowest[a:b]), _steps(highest[a:b]), count[a:b], packed)
            add(block, int(bucket[a]), b - a, size, body)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        size, body = _pack(_steps(first.astype(np.int64)), which.astype(np.int64), sink.getvalue().to_pybytes())
        add(block, -1 - block, len(first), size, body)
        yield pa.RecordBatch.from_pydict(
            rows, pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("raw", pa.int64()), ("body", pa.binary())])
        )


def _answer(rows: list[tuple], window: int):
    """The windows of a bucket that a lower document has, for each block that holds them."""
    parts = []
    for block, n, raw, body in rows:
        data = _unpack(raw, body)
        base, rest = int(data[:8].view(np.int64)[0]), data[8:]
        low, high = (np.cumsum(rest[a * n : (a + 8) * n].view(np.int64)) for a in (0, 8))
        parts.append((block, base, n, low, high, rest[16 * n : 17 * n], rest[17 * n :]))
    rows.clear()
    low, high, count = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
    data = np.concatenate([p[6] for p in parts])
    where = [p[:3] for p in parts]
    del parts
    ends = np.flatnonzero(data == 32)
    words = texts.Words(data, np.append(0, ends[:-1] + 1), ends, np.append(0, np.cumsum(count.astype(np.int64))))
    numbers, hashes = words.hashes()
    starts, counts = texts.shingle_starts(words, window)
    string = np.repeat(np.arange(len(counts)), counts)
    keys = texts.hash_runs(hashes, starts, starts + window)
    del hashes, words, data
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    pair = np.flatnonzero(equal)
    same = _same_runs(numbers, starts[order[pair]], starts[order[pair + 1]], np.full(len(pair), window))
    if not same.all():  # two windows with one hash: sort by the words themselves
        rows = numbers[starts[:, None] + np.arange(window)]
        keys = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
    begun = np.flatnonzero(np.append(True, ~equal))
    lowest = np.minimum.reduceat(low[string[order]], begun)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(lowest, np.diff(np.append(begun, len(order))))
    told = np.flatnonzero(first < high[string])
    offset = starts[told] - np.append(0, np.cumsum(count.astype(np.int64)))[string[told]]
    edge = np.cumsum([0, *[n for _, _, n in where]])
    cut = np.searchsorted(string[told], edge)
    for i, (block, base, _) in enumerate(where):
        a, b = cut[i], cut[i + 1]
        if b > a:
            numbers_here = string[told[a:b]] - edge[i] + base
            yield (block, b - a, *_pack(numbers_here.astype(np.int64), first[told[a:b]], offset[a:b].astype(np.int64)))


def _settle(batches, window: int):
    """Pass blocks on; turn the rows of each bucket (they come together) into answers."""
    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("raw", pa.int64()), ("body", pa.binary())])
    held, key = [], None

    def flush():
        if held:
            out = list(_answer(held, window))
            held.clear()
            pa.default_memory_pool().release_unused()
            if out:
                block, n, raw, body = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), pa.array([key] * len(out), pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.int64()), pa.array(body, pa.binary())], schema=schema
                )

    for batch in batches:
        keys = batch.column("key").to_numpy()
        own = np.flatnonzero(keys < 0)
        if len(own):
            yield batch.take(pa.array(own))
        for i in np.flatnonzero(keys >= 0).tolist():
            if keys[i] != key:
                yield from flush()
                key = keys[i]
            held.append(tuple(batch.column(c)[i].as_py() for c in ("block", "n", "raw", "body")))
    yield from flush()


def _finish(table: pa.Table, names: list[str], window: int, kept_text: bool) -> pa.Table:
    """The rows of one block with their covered words removed."""
    whole, told = None, []
    for row in table.select(["key", "n", "raw", "body"]).to_pylist():
        data, n = _unpack(row["raw"], row["body"]), row["n"]
        if row["key"] < 0:
            whole = (np.cumsum(data[: 8 * n].view(np.int64)), data[8 * n : 16 * n].view(np.int64), data[16 * n :])
        else:
            told.append(data.view(np.int64).reshape(3, n))
    first, which, stored = whole
    batch = pa.ipc.open_stream(pa.py_buffer(stored.tobytes())).read_all().combine_chunks().to_batches()[0]
    words = texts.split_words(batch.column("text"))
    ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
    total = len(words.starts)
    edges = np.zeros(total + 1, np.int64)
    if told:
        string, lowest, offset = np.concatenate(told, axis=1)
        order = np.argsort(which, kind="stable")
        begin, end = (np.searchsorted(which[order], string, side) for side in ("left", "right"))
        held = order[texts.spread_out(begin, end - begin)]
        word = first[held] + np.repeat(offset, end - begin)
        word = word[np.repeat(lowest, end - begin) < ids[words.text_of[word]]]
        edges += np.bincount(word, minlength=total + 1) - np.bincount(word + window, minlength=total + 1)
    removed = np.cumsum(edges[:-1]) > 0
    size = words.ends - words.starts + 1
    data = words.data[np.repeat(~removed, size)].tobytes()
    gone, place = np.append(0, np.cumsum(removed)), np.append(0, np.cumsum(np.where(removed, 0, size)))
    n_removed, place = np.diff(gone[words.first]), place[words.first].tolist()
    kept = [data[a : max(a, b - 1)] for a, b in zip(place, place[1:])]
    made = {name: batch.column(name) for name in batch.schema.names} | {
        "n_words": pa.array(np.diff(words.first), pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
    }
    if kept_text:
        made["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.table([made[name] for name in names], names=names)


def deduplicate(docs: DataFrame, window: int = WINDOW, kept_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    Words are parted by ASCII blanks and otherwise unchanged. A word goes if a window of
    ``window`` words over it also starts in a document with a smaller doc_id; windows are
    those of the input. ``kept_text`` joins the kept words with one blank,
    ``kept_sha256`` is its digest. A null text has no words. A null doc_id counts as
    larger than any other; rows with the same doc_id don't remove each other's words.
    Columns of ``docs`` with a result's name are replaced, all others are carried along.
    Memory of a task follows its longest text.
    """
    if not MINIMISER < window < 256 - MOST_WINDOWS:
        raise ValueError("a window has 3 to 191 words")
    spark = docs.sparkSession
    made = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    if kept_text:
        made["kept_text"] = T.StringType()
    given = docs.select(
        *[c for c in docs.columns if c not in {"doc_id", "text", *made}],
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    )
    shown = [f for f in given.schema if kept_text or f.name != "text"]
    schema = T.StructType(shown + [T.StructField(name, kind) for name, kind in made.items()])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * partitions
    moved = given.mapInArrow(lambda it: _split(it, window, buckets), _MOVED)
    settled = moved.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(lambda it: _settle(it, window), _MOVED)
    names = schema.names
    return settled.groupBy("block").applyInArrow(lambda table: _finish(table, names, window, kept_text), schema)
