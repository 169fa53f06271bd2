import random
from hashlib import sha256

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from catalogkit.llm import bpe_words
from catalogkit.llm.token_counts import vocabulary_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path(bpe_words.VOCABULARY))


def expected(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest(), decoded


def strange(n, seed=3):
    rng = random.Random(seed)
    signs = list(" \t\n\r　\u0085\x1cab1'.,:!?sl<|ÉÀ×÷;Σσİ“”…") + [
        "<|endoftext|>", "<|startoftext|>", " word", " don't", "t's,", "'re", "é,", "日本", "한", "가", ";̸", "<|ENDOFTEXT|>", "é,", "ñ?"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_words_encode_as_the_whole(tokenizer, odd_texts):
    """Ids of the words, one after another, are those of the text."""
    own = strange(3000) + odd_texts
    words, counts = bpe_words.split(pa.array(own))
    flat, at = words.to_pylist(), 0
    for text, n in zip(own, counts):
        parts = flat[at : at + n]
        at += n
        ids = [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids, text
        assert "".join("".join(parts).split()) == "".join((text or "").split())


@pytest.mark.parametrize("block", [64 << 20, 200])
def test_round_trip(spark, tmp_path, documents, tokenizer, odd_texts, monkeypatch, block):
    """Against the tokenizer on whole texts; small blocks share their words through the table."""
    monkeypatch.setattr(bpe_words, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe_words, "SLICE_BYTES", block)
    given = [*enumerate(strange(150, 8) + odd_texts), (3, "again"), (3, "again"), (None, "no id"), (None, None), (None, None)]
    documents(given).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = bpe_words.round_trip(docs, kept_texts=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(tokenizer, *r) for r in given), key=repr)


def test_no_documents(documents):
    assert bpe_words.round_trip(documents([])).count() == 0


def test_each_word_is_encoded_once(spark, documents, tokenizer, monkeypatch):
    """Equal words of all blocks come by in a row, also over the ends of batches."""
    monkeypatch.setattr(bpe_words, "BLOCK_BYTES", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    docs = documents([(i, "one two two, three") for i in range(20)])
    table = bpe_words.word_table(bpe_words.word_places(docs)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(table) == 4 * len({r.block for r in table}) > 4
    assert {(r.word, tuple(bpe_words.np.frombuffer(r.ids, bpe_words.id_kind(49408)))) for r in table} == {
        (w, tuple(tokenizer.encode(w, add_special_tokens=False).ids)) for w in ("one", "two", ",", "three")}


def test_decode(spark, tokenizer):
    rows = [(1, tokenizer.encode(t, add_special_tokens=False).ids, "x") for t in strange(50)] + [(2, None, "y"), (3, [], "z")]
    got = bpe_words.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string").repartition(2)).collect()
    assert len(got) == len(rows)
    assert all(r.decoded == (None if r.ids is None else tokenizer.decode(r.ids, skip_special_tokens=False)) for r in got)


def test_changed_order_is_an_error():
    """Answers for other words than a block has are never taken."""
    places = pa.table({"block": [1], "doc_ids": [[1]], "counts": [[2]], "n_words": [2], "spots": [bpe_words._pack(bpe_words.np.array([0, 1], "u4"))]})
    words = pa.table({"block": [1], "slot": pa.array([0], pa.int32()), "ids": pa.array([b"\5\0"])})
    with pytest.raises(ValueError, match="another order"):
        bpe_words._answers(places, words, bpe_words.pieces(), False)
