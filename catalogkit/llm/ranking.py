"""Quality scores learned from preference pairs (Bradley-Terry)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from . import texts

#: A document is preferred to those of the other class in its slot: at least so many slots, and one for so many labelled rows.
SLOTS, SLOT_ROWS = 256, 64
#: Pairs of a slot that are held at once, and scores that the search for the cut lists in the end.
_PAIRS_AT_ONCE, _LISTED = 1 << 14, 4096
ROUNDS = 12
PENALTY = 1e-3
THRESHOLD = 0.3
FOLDS = 5
STRETCH = 25

_UPPER = texts.byte_set(range(65, 91))
_LOWER = texts.byte_set(range(97, 123))
_DIGIT = texts.byte_set(range(48, 58))
_STOP = texts.byte_set(b".?;:,")
_BANG = texts.byte_set(b"!")
_SIGN = texts.byte_set(b"#$%&*+<=>@[\\]^_`{|}~/")


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers per text: how it is written, not what it says."""
    words = texts.split_words(column)
    texts_n, n = len(words.first) - 1, np.diff(words.first)
    numbers = words.numbered()[0]
    size = words.ends - words.starts

    def in_word(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[words.data], dtype=np.int64))
        return total[words.ends] - total[words.starts]

    upper, lower, digit, stop, bang, sign = map(in_word, (_UPPER, _LOWER, _DIGIT, _STOP, _BANG, _SIGN))
    before = np.append(-1, numbers[:-1])[: len(numbers)]
    before[words.first[:-1][n > 0]] = -1
    text = words.text_of
    flags = [
        (upper > 1) & (lower == 0), bang > 0, sign > 0, digit > 0, before == numbers, stop > 0, size <= 2, size >= 15,
        (sign == size) & (sign > 0), upper > 0,
    ]
    count = np.maximum(n, 1)
    starts, windows = texts.shingle_starts(words, STRETCH)
    cuts = (np.cumsum(windows) - windows)[windows > 0]
    shares, worst = [], []
    for flag in flags:
        total = np.append(0, np.cumsum(flag))
        share = (total[words.first[1:]] - total[words.first[:-1]]) / count
        most = share.copy()
        if len(starts):
            most[windows > 0] = np.maximum.reduceat(total[starts + STRETCH] - total[starts], cuts) / STRETCH
        shares.append(share)
        worst.append(most)
    pairs = np.unique((text.astype(np.int64) << 32) | numbers)
    distinct = np.bincount(pairs >> 32, minlength=texts_n) / count
    letters = np.bincount(text, weights=size, minlength=texts_n)
    rest = [np.log1p(n), distinct, np.log1p(letters / count), n == 0]
    return np.stack([*shares, *worst, *rest], axis=1).astype(np.float64) if texts_n else np.zeros((0, 2 * len(flags) + 4))


def fold(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(folds: int, which: int, column: str = "doc_id") -> Column:
    """Whether a row is kept for testing; rows without an id are not learned from either."""
    return F.coalesce(fold(column) % folds == which, F.lit(False))


def _with_features(docs: DataFrame, extra: str = "") -> DataFrame:
    """``doc_id``, further columns of a DDL list, and ``x`` with the features of ``text``."""
    names = ["doc_id", *[c.split()[0] for c in extra.split(",") if c]]

    def run(batches):
        for batch in texts.slices(batches, "text"):
            x = features(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*[batch.column(c) for c in names], lists], [*names, "x"])

    return docs.select(*names, "text").mapInArrow(run, f"doc_id long, {extra + ', ' if extra else ''}x array<double>")


class Model:
    """Weights of standardized features, and the score that a document must reach."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, 0.0, 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` at the cut."""
        z = self.slope * (self.raw(x) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _side(flat, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of one class of a slot, and how often each occurs; repeats are merged where there are many rows."""
    rows = np.asarray(flat, np.float64).reshape(-1, width)
    if len(rows) <= SLOT_ROWS:
        return rows, np.ones(len(rows))
    rows, times = np.unique(rows, axis=0, return_counts=True)
    return rows, times.astype(np.float64)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the given numbers."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _at_rank(keys: DataFrame, rank: int) -> float:
    """The number whose ``_ordered`` form is the ``rank``-th lowest ``key``, from 0.

    Rows are counted by leading bits, so only counts and the last few rows reach the driver.
    """
    for shift in (52, 40, 28, 16, 4, 0):
        top = F.shiftright("key", shift)
        counts = sorted(keys.groupBy(top.alias("top")).count().collect())
        at = 0
        while rank >= counts[at]["count"]:
            rank, at = rank - counts[at]["count"], at + 1
        keys = keys.filter(top == counts[at]["top"])
        if counts[at]["count"] <= _LISTED or not shift:
            key = counts[at]["top"] if not shift else sorted(r["key"] for r in keys.collect())[rank]
            bits = np.array([key], np.int64)
            return float(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from all labelled rows of ``docs`` (already without the held-out ones).

    The rows of a slot give all pairs of a preferred and another document; slots grow in number with
    the labelled rows, so the pairs grow in proportion. The logistic loss on the difference of
    their features is minimized by Newton steps whose sums come from the slots' partitions.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").distinct()
    # Merged at any size, so that what moves grows in proportion.
    rows = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id")
    told = cut_lineage(_with_features(rows, "label int").repartition("doc_id"))
    width = features(pa.array([""])).shape[1]
    parts = told.agg(
        *[F.count("*").alias("n"), F.avg(1 - F.col("label")).alias("bad"), F.count_if(F.col("label") == 0).alias("n_bad")],
        *[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(width)],
    ).first()
    if not parts["n"] or not 0 < parts["bad"] < 1:
        return Model(np.zeros(width), np.ones(width), np.zeros(width))
    mean = np.array([parts[f"m{i}"] for i in range(width)])
    scale = np.array([parts[f"s{i}"] for i in range(width)])
    scale[scale < 1e-9] = 1
    model = Model(mean, scale, np.zeros(width))
    own = [F.flatten(F.collect_list(F.when(F.col("label") == k, F.col("x")))).alias(n) for k, n in ((1, "good"), (0, "bad"))]
    slots = max(SLOTS, -(-parts["n"] // SLOT_ROWS))
    slotted = told.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)))
    pairs = cut_lineage(slotted.groupBy("slot").agg(*own).filter("size(good) > 0 and size(bad) > 0").select("good", "bad"))

    def sums(weights):
        def run(batches):
            total, n = np.zeros((width + 1, width)), 0.0
            for batch in batches:
                for good, bad in zip(*(batch.column(c) for c in ("good", "bad"))):
                    (a, often), (b, times) = (_side(side.values.to_numpy(zero_copy_only=False), width) for side in (good, bad))
                    step = max(1, _PAIRS_AT_ONCE // len(b))
                    for at in range(0, len(a), step):
                        d = ((a[at : at + step, None] - b[None]) / scale).reshape(-1, width)
                        met = np.outer(often[at : at + step], times).ravel()
                        p = 1 / (1 + np.exp(np.clip(d @ weights, -700, 700)))
                        total[0] += (p * met) @ d
                        total[1:] += (d * (p * (1 - p) * met)[:, None]).T @ d
                        n += met.sum()
            yield pa.record_batch([pa.array([n]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["n", "total"])

        return pairs.mapInArrow(run, "n double, total array<double>")

    for _ in range(ROUNDS):
        found = sums(model.weights).toArrow()
        n = max(1.0, float(np.sum(found.column("n").to_numpy())))
        total = _matrix(found.column("total").combine_chunks()).sum(0).reshape(width + 1, width) / n
        step = np.linalg.solve(total[1:] + PENALTY * np.eye(width), total[0] - PENALTY * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-4:
            break

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(_ordered(model.raw(_matrix(batch.column("x")))))], ["key"])

    # The cut is the quantile of the scores at the share of rejected rows.
    ranked = cut_lineage(told.select("x").mapInArrow(keys, "key long"))
    model.cut = (_at_rank(ranked, parts["n_bad"] - 1) + _at_rank(ranked, parts["n_bad"])) / 2
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with ``score`` and ``predicted`` of their whole ``text``; a null text is empty."""

    def answer(column):
        own = model.score(features(column))
        return pa.array(own), pa.array((own >= THRESHOLD).astype(np.int32))

    return texts.carry(docs, answer, "score double, predicted int")
