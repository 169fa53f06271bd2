"""Overlaps between documents and benchmark items, found by spaced-seed hashing.

A mask selects some of the tokens of a span and ignores the others, so a replaced word
at an ignored place doesn't hide an overlap. Hashes of the selected tokens of both sides
are joined, and around each hit the aligned tokens are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.session import cut_lineage

from . import texts

#: Any 13 or more aligned tokens of which 80 % are equal hold one of these.
LONG_MASKS = (
    "11110111", "110100010111", "11101001011", "1100110011001", "1100011001011", "1110010001101", "1111111",
)
#: By the number of tokens of a shorter item: any way to change a fifth of them leaves one of these.
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11101011", "101100111", "111111"),
}
MASKS = tuple(dict.fromkeys([*LONG_MASKS, *(m for own in SHORT_MASKS.values() for m in own)]))
MIN_WORDS = 13
MIN_EQUAL = 0.8
#: Tokens on either side of a hit that are compared.
REACH = 64
FILTER_BITS = (20, 27)

_BLANK = texts.byte_set(i for i in range(128) if not chr(i).isalnum())


def tokens(values: pa.Array) -> texts.Words:
    """Lower-case runs of letters and digits; every byte outside ASCII counts as a letter."""
    return texts.split_words(pc.utf8_lower(values.cast(pa.large_string())), _BLANK)


def seeds(words: texts.Words, masks: tuple[str, ...]) -> list[tuple[np.ndarray, int]]:
    """For each mask the hash at every token, and the mask's span."""
    own, out = words.hashes()[1], []
    for k, mask in enumerate(masks):
        count, total = max(0, len(own) - len(mask) + 1), np.uint64(k + 1)
        for i, pick in enumerate(mask):
            if pick == "1":
                total = (total + own[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        out.append((texts.mix(total if count else own[:0]), len(mask)))
    return out


def whole(words: texts.Words, places: np.ndarray, span: int) -> np.ndarray:
    """Those places whose span ends within their text."""
    text = np.searchsorted(words.first, places, "right") - 1
    return places[places + span <= words.first[text + 1]]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``(key, item_id, words)``: items by their tokens; equal items share a key."""

    def run(batches):
        for batch in batches:
            words = tokens(batch.column("text"))
            own = [bytes(words.joined(t)) for t in range(batch.num_rows)]
            yield pa.record_batch([batch.column("item_id"), pa.array(own, pa.binary()).cast(pa.string())], ["item_id", "words"])

    given = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    made = given.mapInArrow(run, "item_id long, words string").filter("words != ''")
    return made.select(F.xxhash64("words").alias("key"), "item_id", "words")


def fitting_masks(items: DataFrame, masks: tuple[str, ...] = LONG_MASKS) -> dict[str, set[int]]:
    """Masks with the item lengths that they stand for; 0 is any length outside ``SHORT_MASKS``.

    Masks of lengths that no item has are left out, so they cost nothing.
    """
    length = F.size(F.split("words", " "))
    out = {mask: {0} for mask in masks}
    for row in items.select(length.alias("n")).filter(F.col("n").isin(list(SHORT_MASKS))).distinct().collect():
        for mask in SHORT_MASKS[row["n"]]:
            out.setdefault(mask, set()).add(row["n"])
    return out


def benchmark_seeds(items: DataFrame, masks: dict[str, set[int]]) -> DataFrame:
    """``(hash, key, item_at)`` of every mask at every token of the distinct items that it stands for."""

    def run(batches):
        for batch in batches:
            words = tokens(batch.column("words"))
            keys, found = batch.column("key").to_numpy(), []
            length = np.diff(words.first)
            length[~np.isin(length, list(SHORT_MASKS))] = 0
            for (hashes, span), own in zip(seeds(words, tuple(masks)), masks.values()):
                at = whole(words, np.arange(len(hashes)), span)
                text = np.searchsorted(words.first, at, "right") - 1
                at = at[np.isin(length[text], list(own))]
                text = np.searchsorted(words.first, at, "right") - 1
                found.append((hashes[at].view(np.int64), keys[text], at - words.first[text]))
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], ["hash", "key", "item_at"])

    distinct = items.groupBy("key").agg(F.any_value("words").alias("words"))
    return distinct.mapInArrow(run, "hash long, key long, item_at long").distinct()


def seed_filter(made: DataFrame) -> np.ndarray:
    """Two bits set per seed, in 1 to 128 million bits by the number of seeds.

    A fuller filter lets more documents' hashes through to the join; none is lost.
    """
    few, most = FILTER_BITS
    size = min(most, max(few, (64 * made.count()).bit_length()))
    at = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("at")
    spots = made.select(at).select((F.col("at").bitwiseAND((1 << size) - 1)).alias("at"))
    rows = (
        spots.groupBy(F.shiftright("at", 3).cast("int").alias("byte"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (size - 3), np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def _segments(docs: DataFrame, filled, masks, reach: int) -> DataFrame:
    """Stretches of documents around tokens whose hash may be a seed."""

    def run(batches):
        bits, task, made = filled.value, TaskContext.get().partitionId(), 0
        top = np.uint64(8 * len(bits) - 1)
        for batch in texts.slices(batches, "text"):
            words = tokens(batch.column("text"))
            at, key, end = [], [], []
            for hashes, span in seeds(words, masks):
                hit = np.ones(len(hashes), bool)
                for spot in (hashes & top, (hashes >> np.uint64(32)) & top):
                    hit &= (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                places = whole(words, np.flatnonzero(hit), span)
                at.append(places)
                key.append(hashes[places].view(np.int64))
                end.append(places + span)
            at, key, end = np.concatenate(at), np.concatenate(key), np.concatenate(end)
            order = np.argsort(at, kind="stable")
            at, key, end = at[order], key[order], end[order]
            text = np.searchsorted(words.first, at, "right") - 1
            left = np.maximum(at - reach, words.first[text])
            right = np.minimum(end + reach, words.first[text + 1])
            new = np.append(True, (text[1:] != text[:-1]) | (left[1:] > np.maximum.accumulate(right)[:-1]))[: len(at)]
            cut = np.flatnonzero(new)
            stop = np.append(cut[1:], len(at))
            ids = batch.column("doc_id")
            rows = {"segment": [], "doc_id": [], "start": [], "words": [], "hits": []}
            for a, b in zip(cut.tolist(), stop.tolist()):
                first, last = left[a], right[a:b].max()
                rows["segment"].append((task << 40) | made)
                rows["doc_id"].append(ids[int(text[a])].as_py())
                rows["start"].append(int(first - words.first[text[a]]))
                rows["words"].append(bytes(words.data[words.starts[first] : words.ends[last - 1]]).decode())
                rows["hits"].append([{"at": int(p - first), "hash": int(h)} for p, h in zip(at[a:b], key[a:b])])
                made += 1
            hit = pa.struct([("at", pa.int64()), ("hash", pa.int64())])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(hit)]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(
        run, "segment long, doc_id long, start long, words string, hits array<struct<at: long, hash: long>>"
    )


def longest_overlap(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Start and end of the longest stretch in which at least this share is equal."""
    total = np.append(0.0, np.cumsum(np.where(equal, 1 - share, -share)))
    low = np.minimum.accumulate(total)
    begin = np.searchsorted(-low, -(total + 1e-9))
    length = np.arange(len(total)) - begin
    end = int(np.argmax(length))
    return int(begin[end]), end


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = LONG_MASKS,
    min_words: int = MIN_WORDS,
    min_equal: float = MIN_EQUAL,
    reach: int = REACH,
) -> DataFrame:
    """``(doc_id, item_id, n_words, n_equal, doc_start)``: the longest overlap of each contaminated pair.

    Tokens are lower-case runs of letters and digits. An overlap aligns at least ``min_words``
    tokens (all of a shorter item) of which ``min_equal`` are equal; it is measured within
    ``reach`` tokens of a hit. The given masks hit every overlap of 13 or more words and every
    whole shorter item at 80 %; other ``min_words``, ``min_equal`` or ``masks`` may lose some. An
    item of one word matches wherever that word stands. Text written without blanks is one token
    between ASCII signs, so such an item matches only as the whole of one. Null and empty texts match nothing; null ids
    are shown as null; repeated documents and items give each pair of ids once. A document
    without an overlap has no row. Other columns are ignored.

    What moves is bounded: documents send stretches around hits only, after a bit filter of
    at most 16 MB that every task gets; the filter never decides by itself.
    """
    spark = docs.sparkSession
    items = cut_lineage(benchmark_items(benchmark))
    picked = fitting_masks(items, masks)
    made = cut_lineage(benchmark_seeds(items, picked))
    filled = spark.sparkContext.broadcast(seed_filter(made))
    segments = cut_lineage(_segments(docs, filled, tuple(picked), reach))
    met = (
        segments.select("segment", F.explode("hits").alias("h"))
        .select("segment", "h.*")
        .join(made, "hash")
        .select("segment", "key", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    sides = met.join(segments.select("segment", "doc_id", "start", "words"), "segment").join(
        items.groupBy("key").agg(F.any_value("words").alias("item")), "key"
    )

    def run(batches):
        for batch in batches:
            rows = {name: [] for name in ("doc_id", "key", "n_words", "n_equal", "doc_start")}
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "key", "start", "shift", "words", "item")]
            for doc_id, key, start, shift, words, item in zip(*columns):
                words, item = words.split(" "), item.split(" ")
                a, b = max(0, shift), min(len(words), shift + len(item))
                equal = np.fromiter((x == y for x, y in zip(words[a:b], item[a - shift :])), bool, b - a)
                begin, end = longest_overlap(equal, min_equal)
                if end - begin >= min(min_words, len(item)):
                    for name, value in zip(rows, (doc_id, key, end - begin, int(equal[begin:end].sum()), start + a + begin)):
                        rows[name].append(value)
            yield pa.record_batch([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    found = sides.mapInArrow(run, "doc_id long, key long, n_words long, n_equal long, doc_start long")
    best = found.groupBy("doc_id", "key").agg(
        F.max(F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("before"))).alias("best")
    )
    return best.join(items.select("key", "item_id").distinct(), "key").select(
        "doc_id", "item_id", "best.n_words", "best.n_equal", (-F.col("best.before")).alias("doc_start")
    )
