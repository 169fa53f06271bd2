"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class). The class is a hash of the
token's last three bytes. The first factor is a softmax over classes with three features:
the previous token (an n-gram; the beginning of a text counts as one), the classes of the
previous two, and the classes of the two before those (a skip feature). The second factor has
the token alone as its feature, so its best weights are known: logarithms of counts, with one added.

The previous token has a row of its own for every distinct token of training, kept by the
token's bucket and never in one place: the value of class c is log(1 + n(c) / (PRIOR * P(c))) for
n(c) training tokens of that class after it, times a learned trust for its number of uses.
Weights of class pairs and the trusts are learned, and their number is fixed by the classes.

1. Counting: blocks of rows send each distinct token once, with its training count and the
   classes that follow it, to the token's bucket; buckets answer with those of the whole corpus.
2. A block meets its answers and is written once.
3. Training: ``ROUNDS`` rounds. In each, every task adds up the gradient of its share of the
   training tokens (each token has one round) at the weights that all tasks share; the sum moves the
   weights. A token is left out of its own counts. How rows are split changes only rounding.
4. Scoring: batches of a block's tokens are scored with the learned weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from . import texts

CLASSES = 64
#: Class pairs; ``CLASSES`` itself stands for places before the text.
PAIRS = (CLASSES + 1) ** 2
#: Pseudo-tokens that every previous token is given, dealt like all tokens.
PRIOR = 4.0
#: Trusts: one for each power of two of a previous token's uses.
TRUSTS = 32
ROUNDS = 4
#: Part of the way to the balance of seen and expected counts that a round goes, and what it adds to both.
STEP, DAMPING = 0.7, 4.0
BATCH = 4096
BLOCK_BYTES = 12 << 20
FOLDS, TEST_FOLD = 7, 2
BUCKETS_PER_PARTITION = 2
#: Text for each further bucket, partition of buckets and task of training.
BUCKET_BYTES, PARTITION_BYTES, TASK_BYTES = 32 << 20, 64 << 20, 48 << 20
#: Parts of the gradient, and how many gradients one task adds up at a time.
PARTS, FAN_IN = 16, 256
#: The closing token; no word has a line feed.
_END = b"\n"
_MOVED = "block long, key long, n int, raw long, body binary"
_MOVED_ARROW = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("raw", pa.int64()), ("body", pa.binary())])
_JOINED = "block long, raw long, body binary"
_GRADIENT = "task long, part int, raw long, body binary"


def _pack(*parts) -> tuple[int, bytes]:
    whole = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return len(whole), pa.Codec("zstd", compression_level=3).compress(whole, asbytes=True)


def _unpack(raw: int, body: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, raw, codec="zstd", asbytes=True), np.uint8)


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers with their equal bytes side by side, which compress better."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Tokens:
    """Tokens of several texts: numbers into ``distinct``, each text closed by the end token (number 0)."""

    def __init__(self, column: pa.Array):
        words = texts.split_words(column, change=texts.lower_table())
        numbers, distinct = words.numbered()
        self.numbers = np.insert(numbers + 1, words.first[1:], 0)
        self.first = words.first + np.arange(len(words.first))
        self.distinct = pa.concat_arrays([pa.array([_END + b" "], pa.large_binary()), distinct])
        self.hashes = texts.hash_bytes(self.distinct, seed=7)
        self.classes = token_classes(self.distinct)


def token_classes(distinct: pa.Array) -> np.ndarray:
    """Class of each token (with its blank): the hash of its last three bytes; the end token has the last class."""
    _, offsets, data = distinct.buffers()
    places = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data, end = np.frombuffer(data, np.uint8), places[1:] - 1
    tail = np.zeros(len(distinct), np.uint64)
    for back in (1, 2, 3):
        at = end - back
        tail = tail * np.uint64(257) + np.where(at >= places[:-1], data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    out = (texts.mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64)
    out[tail == (ord(_END) + 1) * 257 * 257] = CLASSES - 1
    return out


def previous(numbers: np.ndarray) -> np.ndarray:
    """Number of the token before each; the end token (of the text before) stands for the beginning."""
    return np.append(0, numbers[:-1])[: len(numbers)]


def contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two rows of the weight table for each token, given the class of every token."""
    n, place = len(classes), np.arange(len(classes)) - np.repeat(first[:-1], np.diff(first))

    def back(steps: int) -> np.ndarray:
        out = np.full(n, CLASSES, np.int64)
        out[steps:] = classes[: max(0, n - steps)]
        out[place < steps] = CLASSES
        return out

    one, two, three, four = (back(k) for k in (1, 2, 3, 4))
    return np.stack([one * (CLASSES + 1) + two, PAIRS + three * (CLASSES + 1) + four])


def to_code(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 16, then eight to a power of two."""
    high = 16 + np.rint(8 * np.log2(np.maximum(counts, 16) / 16))
    return np.where(counts <= 16, counts, np.minimum(high, 255)).astype(np.uint8)


def from_code() -> np.ndarray:
    """The count that each byte stands for."""
    codes = np.arange(256, dtype=np.float64)
    return np.where(codes <= 16, codes, 16 * 2 ** ((codes - 16) / 8))


class Model:
    """Learned weights, and the values of a previous token's counts."""

    def __init__(self, class_counts: np.ndarray, table: np.ndarray | None = None, trust: np.ndarray | None = None):
        share = (class_counts + 1) / (class_counts.sum() + CLASSES)
        self.bias = np.log(share).astype(np.float32)
        self.table = np.zeros((2 * PAIRS, CLASSES), np.float32) if table is None else table
        self.trust = np.ones(TRUSTS, np.float32) if trust is None else trust
        self.learned = (class_counts, self.table, self.trust)
        counts = from_code()[:, None] / (PRIOR * share)
        self.values = np.log1p(counts).astype(np.float32).ravel()
        # The same with one of the class's own tokens left out.
        self.without = np.log1p(np.maximum(counts - 1 / (PRIOR * share), 0)).astype(np.float32)

    def _scores(self, block: Block, at: np.ndarray, left_out: bool):
        """Logarithms of the class probabilities of the tokens ``at``, their values of the previous token, and its trust."""
        before, own = block.before[at], block.own[at]
        codes = block.codes[before]
        values = self.values[codes.astype(np.int32) * CLASSES + np.arange(CLASSES, dtype=np.int32)]
        uses = block.counts[before]
        if left_out:
            line = np.arange(len(at))
            values[line, own] = self.without[codes[line, own], own]
            uses = uses - 1
        trust = np.minimum(np.log2(uses + 1).astype(np.int64), TRUSTS - 1)
        z = values * self.trust[trust][:, None]
        z += self.bias
        for rows in block.rows:
            z += self.table[rows[at]]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z, values, trust

    def class_logs(self, block: Block) -> np.ndarray:
        """Logarithm of the class probability of every token."""
        out = np.empty(len(block.own))
        for a in range(0, len(out), BATCH):
            at = np.arange(a, min(a + BATCH, len(out)))
            out[at] = self._scores(block, at, False)[0][np.arange(len(at)), block.own[at]]
        return out

    def gradient(self, block: Block, at: np.ndarray, total: Gradient) -> None:
        """Add what the tokens ``at`` show and what the model expects of them."""
        at = at[np.argsort(block.rows[0][at], kind="stable")]
        for rows in block.rows:
            total.seen += np.bincount(rows[at] * CLASSES + block.own[at], minlength=total.seen.size).reshape(total.seen.shape)
        for a in range(0, len(at), BATCH):
            some = at[a : a + BATCH]
            z, values, trust = self._scores(block, some, True)
            p = np.exp(z)
            for k, rows in enumerate(block.rows):
                mine, q = rows[some], p
                if k:
                    order = np.argsort(mine, kind="stable")
                    mine, q = mine[order], p[order]
                cuts = np.flatnonzero(np.diff(mine, prepend=-1))
                total.expected[mine[cuts]] += np.add.reduceat(q, cuts, axis=0)
            mean = (p * values).sum(axis=1)
            spread = (p * values * values).sum(axis=1) - mean * mean
            total.slope += np.bincount(trust, weights=values[np.arange(len(some)), block.own[some]] - mean, minlength=TRUSTS)
            total.curve += np.bincount(trust, weights=spread, minlength=TRUSTS)

    def move(self, total: Gradient) -> None:
        """One update by the gradient of all tasks, scaled by its curvature."""
        weight = (total.seen + total.expected) / 2 + DAMPING
        self.table += (STEP * (total.seen - total.expected) / weight).astype(np.float32)
        self.trust += (STEP * total.slope / (total.curve + DAMPING)).astype(np.float32)
        np.clip(self.trust, 0, 2, out=self.trust)


class Gradient:
    """Seen and expected counts of each row and class, slope and curvature of each trust."""

    SHAPES = ((2 * PAIRS, CLASSES), (2 * PAIRS, CLASSES), (TRUSTS,), (TRUSTS,))

    def __init__(self, flat: np.ndarray | None = None):
        flat = np.zeros(sum(int(np.prod(s)) for s in self.SHAPES)) if flat is None else flat
        sizes = np.cumsum([int(np.prod(s)) for s in self.SHAPES])[:-1]
        self.flat = flat
        self.seen, self.expected, self.slope, self.curve = (part.reshape(s) for part, s in zip(np.split(flat, sizes), self.SHAPES))


def _rounded(values: np.ndarray) -> bytes:
    """Floats with 12 bits of precision (an error of 0.02 %), which compress better."""
    bits = values.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(1 << 11)) & np.uint32(0xFFFFF000)).tobytes()


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _by_rank(sizes: np.ndarray) -> np.ndarray:
    """Order of words, sorted by bucket and there by frequency, that takes the first of every bucket, then the second.

    So frequent words have low numbers, and buckets of these ``sizes`` are all it takes to find it again.
    """
    return np.argsort(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), kind="stable")


def _split(batches, buckets: int):
    """Blocks (key below zero) and what each sends to the buckets."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in texts.slices(batches, "text", BLOCK_BYTES):
        block = (task << 32) | made
        made += 1
        tokens = Tokens(batch.column("text"))
        learned = np.repeat(batch.column("learned").to_numpy(zero_copy_only=False).astype(bool), np.diff(tokens.first))
        seen = np.bincount(tokens.numbers[learned], minlength=len(tokens.distinct))
        bucket = (tokens.hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((-np.bincount(tokens.numbers, minlength=len(bucket)), bucket))
        bucket, sorted_words = bucket[order], tokens.distinct.take(pa.array(order)).to_pylist()
        place = _inverse(order)
        before, own = place[previous(tokens.numbers)][learned], tokens.classes[tokens.numbers[learned]]
        follows, times = np.unique(before * CLASSES + own, return_counts=True)
        rows = {name: [] for name in _MOVED_ARROW.names}

        def add(*row):
            for name, value in zip(rows, row):
                rows[name].append(value)

        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(order))
        again = _by_rank(ends - cuts)
        numbers, classes = _inverse(again)[place][tokens.numbers], tokens.classes[order[again]]
        edges = zip(np.searchsorted(follows, cuts * CLASSES).tolist(), np.searchsorted(follows, ends * CLASSES).tolist())
        for a, b, (x, y) in zip(cuts.tolist(), ends.tolist(), edges):
            steps = np.diff(follows[x:y], prepend=a * CLASSES)
            sizes = np.array([a, y - x], np.int64)
            add(block, int(bucket[a]), b - a, *_pack(sizes, seen[order[a:b]].astype(np.int64), _planes(steps), _planes(times[x:y]), b"".join(sorted_words[a:b])))
        sink, head = pa.BufferOutputStream(), batch.select(["doc_id", "held_out", "learned"])
        with pa.ipc.new_stream(sink, head.schema) as out:
            out.write_batch(head)
        sizes = np.array([batch.num_rows, len(order), len(numbers), len(cuts)], np.int64)
        body = (sizes, ends - cuts, tokens.first.astype(np.int64), classes.astype(np.uint8), _planes(numbers), sink.getvalue().to_pybytes())
        add(block, -1 - block, batch.num_rows, *_pack(*body))
        yield pa.RecordBatch.from_pydict(rows, _MOVED_ARROW)


def _answer(rows: list[tuple], bucket: int):
    """Counts of the whole corpus for each block, and the bucket's tokens and distinct tokens by class (block -1)."""
    parts = []
    for block, n, raw, body in rows:
        data = _unpack(raw, body)
        base, m = data[:16].view(np.int64).tolist()
        at = 16 + 8 * n
        follows = np.cumsum(_from_planes(data[at : at + 4 * m]))
        parts.append((block, base, n, data[16:at].view(np.int64), data[at + 8 * m :], follows, _from_planes(data[at + 4 * m : at + 8 * m])))
    rows.clear()
    data = np.concatenate([p[4] for p in parts])
    ends = np.flatnonzero(data == 32)
    words = texts.Words(data, np.append(0, ends[:-1] + 1), ends, np.array([0, len(ends)]))
    numbers, distinct = words.numbered()
    total = np.bincount(numbers, weights=np.concatenate([p[3] for p in parts]), minlength=len(distinct)).astype(np.int64)
    classes = token_classes(distinct)
    sums = np.stack([np.bincount(classes, weights=w, minlength=CLASSES) for w in (total, total > 0)]).astype(np.int64)
    edges = np.cumsum([0, *[p[2] for p in parts]])
    place = np.concatenate([numbers[edge + p[5] // CLASSES] * CLASSES + p[5] % CLASSES for edge, p in zip(edges, parts)])
    held, which = np.unique(place, return_inverse=True)
    codes = np.zeros((len(distinct), CLASSES), np.uint8)
    codes.ravel()[held] = to_code(np.bincount(which, weights=np.concatenate([p[6] for p in parts]), minlength=len(held)))
    for edge, (block, base, n, *_) in zip(edges.tolist(), parts):
        own = numbers[edge : edge + n]
        yield block, bucket, n, *_pack(np.int64(base).tobytes(), total[own], codes[own])
    yield -1, bucket, CLASSES, *_pack(sums)


def _settle(batches):
    """Pass blocks on; turn the rows of each bucket (they come together) into answers."""
    held, key = [], None

    def flush():
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_answer(held, key)), _MOVED_ARROW)], schema=_MOVED_ARROW)
            held.clear()

    for batch in batches:
        keys = batch.column("key").to_numpy()
        own = np.flatnonzero(keys < 0)
        if len(own):
            yield batch.take(pa.array(own))
        for i in np.flatnonzero(keys >= 0).tolist():
            if keys[i] != key:
                yield from flush()
                key = int(keys[i])
            held.append(tuple(batch.column(c)[i].as_py() for c in ("block", "n", "raw", "body")))
    yield from flush()
    texts.settle()


def _join(rows: pa.Table) -> pa.Table:
    """One row of a block and its answers: its own data, then counts, then codes. Block -1: sums of all buckets."""
    block = rows.column("block")[0].as_py()
    whole, answers = None, []
    for row in rows.select(["key", "raw", "body"]).to_pylist():
        data = _unpack(row["raw"], row["body"])
        if block < 0:
            whole = data.view(np.int64) if whole is None else whole + data.view(np.int64)
        elif row["key"] < 0:
            whole = data
        else:
            answers.append(data)
    if block >= 0:
        distinct, _, own = whole[8:32].view(np.int64).tolist()
        again = _by_rank(whole[32 : 32 + 8 * own].view(np.int64))
        counts, codes = np.zeros(distinct, np.int64), np.zeros((distinct, CLASSES), np.uint8)
        for data in answers:
            base, n = int(data[:8].view(np.int64)[0]), (len(data) - 8) // (8 + CLASSES)
            counts[base : base + n] = data[8 : 8 + 8 * n].view(np.int64)
            codes[base : base + n] = data[8 + 8 * n :].reshape(n, CLASSES)
        raw, body = _pack(whole[:24], counts[again], codes[again], whole[32 + 8 * own :])
    else:
        raw, body = _pack(whole)
    return pa.table({"block": pa.array([block], pa.int64()), "raw": pa.array([raw], pa.int64()), "body": pa.array([body], pa.binary())})


class Block:
    """Tokens of a block with what the corpus knows of them."""

    def __init__(self, data: np.ndarray):
        docs, distinct, n = data[:24].view(np.int64).tolist()
        at = 24

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            at += size
            return data[at - size : at].view(kind)

        self.counts, self.codes = take(distinct, np.int64), take(distinct * CLASSES, np.uint8).reshape(-1, CLASSES)
        self.first, classes = take(docs + 1, np.int64), take(distinct, np.uint8).astype(np.int64)
        self.numbers = _from_planes(take(4 * n, np.uint8))
        self.batch = pa.ipc.open_stream(pa.py_buffer(data[at:].tobytes())).read_all()
        self.own = classes[self.numbers]
        self.rows = contexts(self.own, self.first)
        end = self.numbers[-1:]  # every text closes with it
        self.before = np.append(end, self.numbers[:-1])

    def learned(self, turn: int) -> np.ndarray:
        """Training tokens of a round: every ``ROUNDS``-th of a text, the same ones however rows are split."""
        size = np.diff(self.first)
        place = np.arange(len(self.own)) - np.repeat(self.first[:-1] - size, size)
        return np.flatnonzero(np.repeat(self.batch.column("learned").to_numpy().astype(bool), size) & (place % ROUNDS == turn))


def _blocks(batches):
    for batch in batches:
        for raw, body in zip(batch.column("raw"), batch.column("body")):
            yield Block(_unpack(raw.as_py(), body.as_py()))


def _gradient_task(batches, model: Model, turn: int):
    """The gradient of a round's training tokens of a task."""
    total, task, some = Gradient(), TaskContext.get().partitionId(), False
    for block in _blocks(batches):
        at = block.learned(turn)
        if len(at):
            some = True
            model.gradient(block, at, total)
    if some:
        raw, body = zip(*[_pack(_rounded(part)) for part in np.array_split(total.flat, PARTS)])
        yield pa.record_batch(
            [pa.array([task] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array(raw, pa.int64()), pa.array(body, pa.binary())],
            ["task", "part", "raw", "body"],
        )
    texts.settle()


def _add_up(rows: pa.Table) -> pa.Table:
    total = None
    for raw, body in zip(rows.column("raw").to_pylist(), rows.column("body")):
        own = _unpack(raw, body.as_py()).view(np.float32)
        total = own.astype(np.float64) if total is None else total + own
    raw, body = _pack(total.astype(np.float32))
    return pa.table({"task": rows.column("task").slice(0, 1), "part": rows.column("part").slice(0, 1), "raw": pa.array([raw], pa.int64()), "body": pa.array([body], pa.binary())})


def train(blocks: DataFrame, class_counts: np.ndarray, tasks: int) -> Model:
    """Weights learned from all training tokens of written ``blocks``, whose classes occur ``class_counts`` times."""
    context, model = blocks.sparkSession.sparkContext, Model(class_counts)
    for turn in range(ROUNDS):
        shared = context.broadcast(model.learned)
        made = blocks.coalesce(tasks).mapInArrow(lambda it, shared=shared, turn=turn: _gradient_task(it, Model(*shared.value), turn), _GRADIENT)
        if tasks > FAN_IN:  # no task adds up more than a fixed number of gradients
            made = made.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task", "part").applyInArrow(_add_up, _GRADIENT)
        whole = made.withColumn("task", F.lit(0).cast("long")).groupBy("task", "part").applyInArrow(_add_up, _GRADIENT)
        parts = sorted(whole.toArrow().to_pylist(), key=lambda r: r["part"])
        shared.destroy()
        if parts:
            model.move(Gradient(np.concatenate([_unpack(r["raw"], r["body"]).view(np.float32) for r in parts]).astype(np.float64)))
    return model


def _score_task(batches, model: Model, sums: np.ndarray, names: list[str]):
    """Scores of documents. ``sums``: training tokens and distinct ones by class."""
    known, vocabulary = sums.sum(axis=1)
    for block in _blocks(batches):
        size = np.diff(block.first)

        def per_doc(values):
            return pa.array(np.add.reduceat(values, block.first[:-1]))

        counts = block.counts[block.numbers]
        word_logs = np.log10((counts + 1) / (sums[0] + sums[1] + 1)[block.own])
        yield pa.record_batch(
            [
                block.batch.column("doc_id").combine_chunks(), block.batch.column("held_out").combine_chunks(), pa.array(size, pa.int64()),
                per_doc((counts > 0).astype(np.int64)), pa.array(np.full(len(size), known), pa.int64()),
                per_doc(np.log10((counts + 1) / (known + vocabulary + 1))), per_doc(model.class_logs(block) / np.log(10) + word_logs),
            ],
            names,
        )
    texts.settle()


def score(docs: DataFrame, folds: int = FOLDS, test_fold: int = TEST_FOLD) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row's whole text.

    Tokens are words with A-Z lowered, then one end; a null text is the end alone. Rows whose
    crc32 of the doc_id modulo ``folds`` is ``test_fold`` are held out, all others with an id
    are learned from. ``base_score`` is the add-one unigram model, ``score`` this model;
    both are sums of log10 over the tokens. Tokens that training lacks share one place in
    their class. If nothing can be learned from, all classes are equally likely.
    """
    spark: SparkSession = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(fold == test_fold, F.lit(False)).alias("held_out"), F.coalesce(fold != test_fold, F.lit(False)).alias("learned"),
    )
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, size // PARTITION_BYTES)
    buckets = max(BUCKETS_PER_PARTITION * least, size // BUCKET_BYTES)
    moved = given.mapInArrow(lambda it: _split(it, buckets), _MOVED)
    settled = moved.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_settle, _MOVED)
    joined = cut_lineage(settled.groupBy("block").applyInArrow(_join, _JOINED))
    told = joined.filter("block = -1").collect()
    sums = _unpack(told[0]["raw"], told[0]["body"]).view(np.int64).reshape(2, CLASSES) if told else np.zeros((2, CLASSES), np.int64)
    blocks = joined.filter("block >= 0")
    shared = spark.sparkContext.broadcast(train(blocks, sums[0], 1 + size // TASK_BYTES).learned)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [part.split()[0] for part in schema.split(", ")]
    return blocks.mapInArrow(lambda it: _score_task(it, Model(*shared.value), sums, names), schema)
