"""Token counts of whole texts by a public tokenizer, and the encoder that packing shares."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
BATCH_BYTES = 16 << 10
SLICE_BYTES = 4 << 20
#: Pieces an encoder remembers before it starts anew, some 150 bytes each.
MOST_PIECES = 1 << 19


def safe_pieces(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of texts start, and how many each text has.

    A byte-level BPE with the usual word pattern never joins a blank to the
    non-blank before it, so a text may be cut there and its pieces encoded apart. After
    bytes that may end another kind of white space, and after control bytes, it is not cut.
    """
    at = np.flatnonzero(data == 32)
    cut = np.zeros(len(data), bool)
    cut[at[~maybe_white(data, at)]] = True
    cut[places[:-1][np.diff(places) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.searchsorted(starts, places))


def maybe_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place may be white space or a control."""
    one, two, three = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    white = (ends < 1) | (one <= 32) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    return white | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))


def loaded(path: str) -> tuple:
    """The tokenizer of a file and the bytes of each of its ids, made once by a worker for all of its tasks.

    Functions travel to tasks by value, so a variable of this module would be new in each task.
    """
    held = sys.modules.setdefault("_catalogkit_worker", types.ModuleType("_catalogkit_worker")).__dict__
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        # A byte-level token has one character per byte; added tokens stand for themselves.
        added = {i: len(t.content.encode()) for i, t in own.get_added_tokens_decoder().items()}
        n = own.get_vocab_size(with_added_tokens=True)
        ids = range(max([n - 1, *added]) + 1)
        held[path] = own, np.array([added[i] if i in added else len(own.id_to_token(i) or "") for i in ids], np.int64)
    return held[path]


class PieceEncoder:
    """Ids of pieces of text; a distinct piece is encoded once and remembered."""

    def __init__(self, path: str, closing: int | None = None):
        (self.tokenizer, self.bytes), self.closing = loaded(path), closing
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        if self.closing is not None:
            self._keep([b""], np.ones(1, np.int64), np.array([self.closing]))

    def _keep(self, pieces: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, ids.astype(np.uint32))

    def _encode(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids per piece of ``data``, and all ids; a batch has texts of about equal bytes.

        Pieces from a blank to a solid character may stand behind one another in
        a text of the batch, and the bytes of the ids tell them apart. Others are texts of their own.
        """
        raw = np.frombuffer(data, np.uint8)
        begins = np.append(0, ends[:-1])
        plain = (raw[begins] == 32) & ~maybe_white(raw, ends)
        group = begins // BATCH_BYTES
        new = np.append(True, ~plain[1:] | ~plain[:-1] | (group[1:] != group[:-1]))
        cuts = begins[new].tolist()
        batch = [data[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(data)])]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        ids = np.concatenate([np.array(x, np.int64) for x in found])
        if self.bytes[ids].sum() != len(data):
            raise ValueError("the tokenizer does not keep every byte of its texts")
        return np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), np.append(0, ends), "right")), ids

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of each piece; ``sizes``, ``begin`` and ``ids`` go by it."""
        if len(self.known) > MOST_PIECES:
            self.forget()
        cuts = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.known]
        if new:
            self._keep(new, *self._encode(b"".join(new), np.cumsum([len(x) for x in new])))
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return own[pieces.indices.to_numpy(zero_copy_only=False)]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row; a null text is empty.

    Texts go through the tokenizer whole, without special tokens added; strings of
    special tokens in a text are taken as its default takes them. Tasks work on slices of
    equal bytes and return lengths only. Other columns are ignored.
    """

    def run(batches):
        encoder = PieceEncoder(vocabulary_path(vocabulary))
        for batch in texts.slices(batches, "text", SLICE_BYTES):
            data, places = texts.raw(batch.column("text"))
            starts, pieces = safe_pieces(data, places)
            numbers = encoder.numbers(data, starts) if len(starts) else starts
            own = encoder.sizes[numbers]
            tokens = np.diff(np.append(0, np.cumsum(own))[np.append(0, np.cumsum(pieces))])
            columns = [batch.column("doc_id"), pa.array(np.diff(places), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        encoder.forget()
        texts.settle()

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
