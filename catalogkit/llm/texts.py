"""Whole columns of text as byte arrays: words, hashes and slices of bounded size.

Everything here runs inside Arrow tasks and works on the buffers of a batch at once.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (32, 9, 10, 11, 12, 13)


def byte_set(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def lower_table() -> np.ndarray:
    """Byte values with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


@dataclass
class Words:
    """Words of several texts in one buffer, each followed by one blank.

    Word ``i`` is ``data[starts[i]:ends[i]]``; text ``t`` has the words ``first[t]`` to ``first[t + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, text: int) -> memoryview:
        """The words of a text, one blank between them."""
        a, b = self.first[text], self.first[text + 1]
        return memoryview(self.data[self.starts[a] : self.ends[b - 1]] if b > a else self.data[:0])

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """A number per word, and the distinct words (with their blank) by number."""
        places = np.append(self.starts, len(self.data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(places), pa.py_buffer(self.data)]
        ).dictionary_encode()
        return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary

    def hashes(self, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Number and 64-bit hash of each word."""
        numbers, distinct = self.numbered()
        return numbers, hash_bytes(distinct, seed)[numbers]


def split_words(texts: pa.Array, blank: np.ndarray | None = None, change: np.ndarray | None = None) -> Words:
    """Words between blank bytes; ``change`` maps the bytes of words."""
    blank = byte_set(BLANKS) if blank is None else blank
    closed = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), *[pa.scalar(x, pa.large_string()) for x in ("", " ")])
    data, places = raw(closed)
    solid = ~blank[data]
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    closing = np.flatnonzero(kept & ~solid)
    out = data[kept]
    ends = np.cumsum(kept)[closing] - 1
    if change is not None:
        out = change[out]
    out[ends] = 32
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    return Words(out, starts, ends, np.searchsorted(closing, places))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def raw_bytes(values: pa.Array) -> np.ndarray:
    """Bytes of a large binary array without nulls, one value after another."""
    _, offsets, data = values.buffers()
    places = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else [0, 0]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)


def settle() -> None:
    """Give what Arrow and numpy have freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of values, by differences of one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _powers(_STEP, len(values)), out=total[1:])
    back = _powers(_BACK, len(values) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def hash_bytes(values: pa.Array, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte string, the same in every task."""
    _, offsets, data = values.buffers()
    places = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values) or data is None:
        return np.zeros(len(values), np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
    own = table[np.frombuffer(data, np.uint8)[places[0] : places[-1]]]
    return hash_runs(own, places[:-1] - places[0], places[1:] - places[0])


def spread_out(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places ``starts[i] .. starts[i] + counts[i] - 1``, run after run."""
    if not len(counts):
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(len(shift))


def shingle_starts(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every run of ``size`` words within a text, and how many each text has."""
    counts = np.maximum(np.diff(words.first) - size + 1, 0)
    return spread_out(words.first[:-1], counts), counts


def carry(docs, answer, made: str, column: str = "text"):
    """Rows of ``docs`` with the columns that ``answer(text array)`` returns, in slices of bounded size.

    ``made`` is the DDL list of those columns; columns of ``docs`` with such a name are
    replaced, all others are carried along unread.
    """
    from pyspark.sql import types as T

    fresh = T.StructType.fromDDL(made)
    given = docs.select(*[c for c in docs.columns if c not in fresh.names])
    names = given.columns

    def run(batches):
        for batch in slices(batches, column):
            yield pa.record_batch([*batch.columns, *answer(batch.column(column))], [*names, *fresh.names])

    return given.mapInArrow(run, T.StructType([*given.schema, *fresh]))
