import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from catalogkit.llm import substrings, texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    words = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    low = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                low[key] = min(i, low.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            first = low.get(tuple(w[k : k + window]))
            if first is not None and (i is None or first < i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def results(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [13, 5])
def test_against_brute_force(documents, window, odd_texts, monkeypatch):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcd") + str(rng.randint(0, 3)) for _ in range(rng.randint(10, 40))) for _ in range(6)]
    rows = [(i, "  \n".join(rng.choice(passages + ["x y z"]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(odd_texts)]
    rows += [(7, passages[0] + " more"), (None, passages[1] + " end"), (None, "no copy of this here at all")]
    df = substrings.deduplicate(documents(rows).repartition(5), window)
    assert results(df) == brute(rows, window)
    assert {"score", "lang", "key", "block", "text"} <= set(df.columns)


def test_equal_hashes_of_unequal_runs(monkeypatch):
    """With a hash that tells nothing, the words themselves decide."""
    monkeypatch.setattr(texts, "hash_runs", lambda values, starts, ends: (ends - starts).astype(np.uint64))
    words = texts.split_words(pa.array([" ".join(f"w{(i * k) % 7}" for k in range(25)) for i in range(14)]))
    numbers, _ = words.numbered()
    first, size = words.first[:-1], np.full(14, 25)
    chosen, which = substrings._distinct_runs(numbers, np.arange(len(numbers), dtype=np.uint64), first, size)
    for i, j in enumerate(which):
        assert (numbers[first[i] : first[i] + 25] == numbers[first[chosen[j]] : first[chosen[j]] + 25]).all()


def test_no_rows(documents):
    assert substrings.deduplicate(documents([])).count() == 0
