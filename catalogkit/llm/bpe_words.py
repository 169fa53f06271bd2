"""Encoding and decoding of whole texts through a table of distinct words.

Texts are split into words in Spark tasks. A block of texts keeps its words' places and sends each
distinct word once to the word table, where a word of the whole corpus is encoded once. The ids
come back to the places of the block and meet the pieces of the vocabulary there, by id.
"""

from __future__ import annotations

import os
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts
from .token_counts import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Text of a block, up to one more text; larger blocks send a word less often.
BLOCK_BYTES = 32 << 20
#: Text that is split at once.
SLICE_BYTES = 4 << 20

_LETTERS = texts.byte_set([*range(65, 91), *range(97, 123)])
_STOPS = texts.byte_set(b".,;:!?")
#: Continuation bytes that make no letter behind the byte C3: the signs for times and divided by.
_NO_LETTER = texts.byte_set((0x97, 0xB7))


def split(values: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words at all places of all texts, and places per text.

    A word is a run without ASCII white space, cut once more between a Latin letter and a full stop,
    comma, colon, semicolon, exclamation or question mark behind it. A tokenizer that drops
    white space and parts letters from signs never joins what is cut here, so words encode alone.
    """
    data, places = texts.raw(values)
    white = texts.byte_set(texts.BLANKS)[data]
    first = np.zeros(len(data) + 1, bool)
    first[places[:-1]] = True
    begin = ~white
    inner = begin.copy()
    inner[1:] &= ~white[:-1]
    inner &= ~first[:-1]
    letter = _LETTERS[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & ~_NO_LETTER[data[1:]]
    cut = np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & _STOPS[data[1:]]
    begin &= ~inner | cut
    starts = np.flatnonzero(begin)
    closed = np.append(white, True)
    closed[:-1] |= begin
    closed |= first
    stops = np.flatnonzero(closed)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    sizes = ends - starts
    packed = data[~white]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(packed))
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, places))


def _merged(held: list[tuple]):
    """A block: its name, doc ids, words by frequency, their numbers at all places, and places per text.

    The name is a digest of all that, so a block that a lost task makes again has the name it had.
    """
    ids, words, counts = zip(*held)
    words = pa.chunked_array(words).unify_dictionaries()
    numbers = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in words.chunks])
    distinct = words.chunk(0).dictionary
    order = np.argsort(-np.bincount(numbers, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(distinct), np.uint32)
    rank[order] = np.arange(len(distinct), dtype=np.uint32)
    distinct, spots = distinct.take(pa.array(order)), rank[numbers]
    ids, counts = [i for own in ids for i in own.to_pylist()], np.concatenate(counts)
    name = blake2b(spots.tobytes(), digest_size=8)
    name.update(texts.hash_bytes(distinct.cast(pa.large_binary())).tobytes())
    name.update(repr(ids).encode() + counts.tobytes())
    return int.from_bytes(name.digest(), "little", signed=True), ids, distinct, spots, counts


def _blocks(batches):
    """Blocks of a task's texts, each split in slices."""
    held, size = [], 0
    for batch in texts.slices(batches, "text", SLICE_BYTES):
        own = batch.column("text")
        held.append((batch.column("doc_id"), *split(own)))
        size += own.nbytes
        if size >= BLOCK_BYTES:
            yield _merged(held)
            held, size = [], 0
            texts.settle()
    if held:
        yield _merged(held)
    texts.settle()


#: Places are most of what moves, so they are packed with some care.
_CODEC, _LEVEL = "zstd", 9


def _pack(spots: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of bytes."""
    planes = spots.view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.Codec(_CODEC, compression_level=_LEVEL).compress(planes, asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, _CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def word_places(docs: DataFrame) -> DataFrame:
    """``(block, slot, word)``: the distinct words of each block."""

    def run(batches):
        for name, _, words, _, _ in _blocks(batches):
            # In order, words share their beginnings with those before, which shuffles compress.
            slots = pc.sort_indices(words).cast(pa.int32())
            for start in range(0, len(words), 1 << 16):
                own = slots.slice(start, 1 << 16)
                yield pa.record_batch([pa.repeat(pa.scalar(name), len(own)), own, words.take(own).cast(pa.string())], ["block", "slot", "word"])

    return _given(docs).mapInArrow(run, "block long, slot int, word string")


def block_places(docs: DataFrame) -> DataFrame:
    """``(block, doc_ids, counts, n_words, spots)``: one row per block, with the word at every place."""

    def run(batches):
        for name, doc_ids, words, spots, counts in _blocks(batches):
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (doc_ids, counts.tolist())]
            rest = [pa.array([len(words)], pa.int32()), pa.array([_pack(spots)], pa.binary())]
            yield pa.record_batch([pa.array([name], pa.int64()), *lists, *rest], ["block", "doc_ids", "counts", "n_words", "spots"])

    return _given(docs).mapInArrow(run, "block long, doc_ids array<long>, counts array<long>, n_words int, spots binary")


def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path(vocabulary))
    own.no_truncation()
    own.no_padding()
    return own


def pieces(vocabulary: str = VOCABULARY) -> pa.Array:
    """The piece of every id, added tokens included, closed by a blank; as many as the vocabulary has."""
    known = _tokenizer(vocabulary).get_vocab(with_added_tokens=True)
    by_id = [""] * (max(known.values()) + 1)
    for piece, i in known.items():
        by_id[i] = piece + " "
    return pa.array(by_id, pa.large_string())


def id_kind(n: int) -> str:
    """How an id of ``n`` is packed."""
    return "<u2" if n <= 1 << 16 else "<u4"


def word_table(places: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(block, slot, word, ids)``: every distinct word of all blocks encoded once, for each block that has it.

    ``ids`` are packed as little-endian numbers, of 16 bits where the vocabulary allows it. Words are dealt by their hash and sorted, so equal ones stream by in a row: nothing is held for a
    word, however many blocks have it.
    """

    kind = id_kind(len(pieces(vocabulary)))

    def run(batches):
        tokenizer, last = _tokenizer(vocabulary), (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("word").dictionary_encode()
            words, known = own.dictionary.to_pylist(), int(own.dictionary[0].as_py() == last[0])
            found = [last[1]] * known + [x.ids for x in tokenizer.encode_batch_fast(words[known:], add_special_tokens=False)]
            last = (words[-1], found[-1])
            ids = pa.array([np.array(x, kind).tobytes() for x in found], pa.binary()).take(own.indices)
            yield pa.record_batch([*(batch.column(c) for c in ("block", "slot", "word")), ids], ["block", "slot", "word", "ids"])

    dealt = places.select("block", "slot", "word").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "block long, slot int, word string, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of ``encoded`` with ``decoded``, the pieces of ``ids`` in order with a blank between them; null ids give null.

    An id joins its piece by its place in the vocabulary, whose size bounds what a task holds.
    """

    @F.arrow_udf("string")
    def joined(ids: pa.Array) -> pa.Array:
        own = ids.flatten()
        cuts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        found = [bytes(x).decode() for x in _joined(pieces(vocabulary), own.to_numpy(zero_copy_only=False), cuts)]
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), pa.array(found, pa.string()))

    return encoded.withColumn("decoded", joined("ids"))


def _joined(own: pa.Array, numbers: np.ndarray, edges: np.ndarray):
    """Bytes of the answers at places ``edges[k]`` to ``edges[k + 1]``, without the last blank."""
    taken = own.take(pa.array(numbers))
    _, offsets, data = taken.buffers()
    cuts = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1][edges]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _worded(tokens: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Tokens of each word, one after another, as one text a word."""
    taken = tokens.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    edges = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1][cuts]
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(edges)), data)


def _answers(places: pa.Table, words: pa.Table, tokens: pa.Array, kept_texts: bool) -> pa.Table:
    """Rows of a block's documents from the ids of its words."""
    known, order = np.unique(words.column("slot").to_numpy(), return_index=True)
    own = words.column("ids").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
    kind = np.dtype(id_kind(len(tokens)))
    n_ids = pc.binary_length(own).to_numpy(zero_copy_only=False) // kind.itemsize
    flat, cuts = texts.raw_bytes(own).view(kind), np.append(0, np.cumsum(n_ids))
    decimals = pa.array([f"{i} " for i in range(len(tokens))], pa.large_string())
    ids, decoded = _worded(decimals, flat, cuts), _worded(tokens, flat, cuts)
    rows: list[list] = [[], [], [], [], []]
    for row in places.to_pylist():
        if len(known) != row["n_words"]:
            raise ValueError("the documents came in another order when they were read again")
        edges = np.append(0, np.cumsum(row["counts"])).astype(np.int64)
        numbers = _unpack(row["spots"], int(edges[-1]))
        rows[0] += row["doc_ids"]
        # A run of documents at a time bounds the bytes that are laid out.
        for a in range(0, len(row["doc_ids"]), 256):
            here = edges[a : a + 257] - edges[a]
            run = numbers[edges[a] : edges[a] + here[-1]]
            rows[1] += np.diff(np.append(0, np.cumsum(n_ids[run]))[here]).tolist()
            rows[2] += [sha256(x).hexdigest() for x in _joined(ids, run, here)]
            found = _joined(decoded, run, here)
            rows[3] += [sha256(x).hexdigest() for x in found]
            if kept_texts:
                rows[4] += [bytes(x).decode() for x in found]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"][: 5 if kept_texts else 4]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.table([pa.array(r, t) for r, t in zip(rows, kinds[: len(names)])], names=names)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, kept_texts: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, and the decoded text if asked for.

    Ids are those of the tokenizer for the whole text, without special tokens added; strings of
    special tokens in a text are taken as its default takes them. Null and empty texts have no
    ids. Rows that share a doc_id, or have none, stay rows of their own; other columns are ignored.

    The tokenizer must drop white space, part letters from signs and decode ids to pieces joined by a blank.
    ``docs`` is read twice and must give the same rows in the same order, as a written table does;
    where it doesn't, an error says so. A block is bounded, or one text: memory follows the longest.
    """
    encoded = word_table(word_places(docs), vocabulary).select("block", "slot", "ids")
    tokens = pieces(vocabulary)

    def run(key, left, right):
        answers = _answers(left, right, tokens, kept_texts)
        texts.settle()
        return answers

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * kept_texts
    return block_places(docs).groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, schema)
