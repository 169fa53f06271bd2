"""Packing of token streams into sequences by minimum bin slack.

A task tokenizes its rows and packs them as it reads, so nothing is shuffled and every
piece is made where its ids are. Full windows of a document are sequences of their own;
what remains of each document is packed with what remains of others.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts
from .token_counts import SLICE_BYTES, VOCABULARY, PieceEncoder, safe_pieces, vocabulary_path

CAPACITY = 1024
CLOSING_ID = 0
#: Remainders a task holds back for a better fit before it cuts one to fill a sequence.
MOST_WAITING = 4096

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> list[int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is closest to the capacity from below.

    The sums reachable with the first lengths are one bit set each; walking back through
    the sets gives the lengths that were taken. Longer lengths are tried first.
    """
    mask, sums = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            after = sums | (sums << length) & mask
            if after == sums:
                break
            steps.append((length, sums))
            sums = after
        if sums >> capacity:
            break
    rest, taken = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> rest & 1:
            taken.append(length)
            rest -= length
    return taken


class Packer:
    """Fills sequences of one task; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.count = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.emit([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if whole < len(ids):
            self.wait((doc_id, whole, ids[whole:].copy(), len(ids)))

    def wait(self, piece) -> None:
        self.waiting[len(piece[2])].append(piece)
        self.count += 1

    def take(self, length: int):
        own = self.waiting[length]
        piece = own.pop()
        if not own:
            del self.waiting[length]
        self.count -= 1
        return piece

    def fill(self) -> list:
        """The longest waiting piece and those that leave the least slack beside it."""
        longest = max(self.waiting)
        pieces = [self.take(longest)]
        room = self.capacity - longest
        if room and self.waiting:
            lengths = {length: len(own) for length, own in self.waiting.items() if length <= room}
            pieces += [self.take(length) for length in closest_fill(lengths, room)]
        return pieces

    def pack(self, last: bool = False) -> None:
        """Fill sequences without slack; a slack that no length fits is filled by cutting a piece.

        Before the last call that is only done to keep the number of waiting pieces bounded.
        """
        while self.count:
            pieces = self.fill()
            slack = self.capacity - sum(len(p[2]) for p in pieces)
            if slack and not last and self.count + len(pieces) <= MOST_WAITING:
                for piece in pieces:
                    self.wait(piece)
                return
            if slack and self.count:
                doc_id, start, ids, total = self.take(max(self.waiting))
                pieces.append((doc_id, start, ids[:slack], total))
                self.wait((doc_id, start + slack, ids[slack:], total))
            elif slack:
                self.powers(pieces)
                continue
            self.emit(pieces)

    def powers(self, pieces: list) -> None:
        """The last tokens of a task, as sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own = []
            while size:
                doc_id, start, ids, total = pieces.pop()
                own.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    pieces.append((doc_id, start + size, ids[size:], total))
                size -= len(own[-1][2])
            self.emit(own)

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 7
        self.rows = []
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document is its ids and a closing id 0; a null or empty text is that id alone. Each
    id is in one piece, and pieces lie without gaps in sequences of at most ``capacity``
    ids. All sequences are full, but for at most ten per task whose lengths are powers of
    two. Rows may share a doc_id or have none; their pieces then show the same. A lost
    task makes the same sequences again, as their ids come from its number and order.
    """

    def run(batches):
        encoder = PieceEncoder(vocabulary_path(vocabulary), CLOSING_ID)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        for batch in texts.slices(batches, "text", SLICE_BYTES):
            data, places = texts.raw(batch.column("text"))
            starts, pieces = safe_pieces(data, places)
            numbers = encoder.numbers(data, starts) if len(starts) else starts
            numbers = np.insert(numbers, np.cumsum(pieces), 0)
            sizes = encoder.sizes[numbers]
            ids = encoder.ids[texts.spread_out(encoder.begin[numbers], sizes)]
            ends = np.cumsum(sizes)[np.cumsum(pieces + 1) - 1].tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), [0, *ends], ends):
                packer.add(doc_id, ids[a:b])
            packer.pack()
            yield packer.drain()
        packer.pack(last=True)
        yield packer.drain()
        encoder.forget()
        texts.settle()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)
