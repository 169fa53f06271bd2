import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from catalogkit.llm import packing, texts, token_counts

PATH = token_counts.vocabulary_path(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def rows(odd_texts):
    rng = random.Random(4)
    signs = list(" \t\n  　\u0085ab1é'.sll<|") + ["<|endoftext|>", " word", " don't"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [*enumerate(made + odd_texts), (3, "again"), (None, "no id"), (None, None)]


def test_pieces_encode_as_the_whole(tokenizer, odd_texts):
    own = [t for _, t in rows(odd_texts)]
    encoder = token_counts.PieceEncoder(PATH)
    data, places = texts.raw(pa.array(own))
    starts, counts = token_counts.safe_pieces(data, places)
    numbers, edge = encoder.numbers(data, starts), np.append(0, np.cumsum(counts))
    for i, text in enumerate(own):
        got = [k for n in numbers[edge[i] : edge[i + 1]] for k in encoder.ids[encoder.begin[n] :][: encoder.sizes[n]]]
        assert got == ids_of(tokenizer, text)


def test_counts(documents, tokenizer, odd_texts, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_PIECES", 50)
    given = rows(odd_texts)
    got = token_counts.count_tokens(documents(given).repartition(3)).collect()
    expected = [(i, len((t or "").encode()), len(ids_of(tokenizer, t)), len(ids_of(tokenizer, t)) > 512) for i, t in given]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(documents([])).count() == 0


@pytest.mark.parametrize("waiting", [4096, 3])
def test_packing_round_trip(documents, tokenizer, odd_texts, monkeypatch, waiting):
    monkeypatch.setattr(packing, "MOST_WAITING", waiting)
    given = [r for r in rows(odd_texts) if r[0] is not None and r != (3, "again")]
    pieces = packing.pack(documents(given).repartition(3)).collect()
    whole = {i: np.array([*ids_of(tokenizer, t), 0], "<u4") for i, t in given}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(whole[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans, total in [(by_doc[i], len(w)) for i, w in whole.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert total is None or at == total
    sizes = [sum(n for _, n in s) for s in by_sequence.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes) and max(sizes) <= 1024
    assert sum(n != 1024 for n in sizes) <= 30


def test_pieces_of_repeated_and_missing_ids(documents):
    pieces = packing.pack(documents([(1, "a"), (1, "a"), (None, None)]).coalesce(1)).collect()
    assert sum(p.length for p in pieces if p.doc_id is None) == 1 and sum(p.length for p in pieces if p.doc_id == 1) == 4
    assert packing.pack(documents([])).count() == 0


def test_closest_fill_is_closest():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        sums = {0: []}
        for length, n in counts.items():
            for _ in range(n):
                sums = {**{s + length: [*own, length] for s, own in sums.items()}, **sums}
        taken = packing.closest_fill(counts, 40)
        assert sum(taken) == max(s for s in sums if s <= 40)
        assert all(taken.count(x) <= counts[x] for x in taken)
