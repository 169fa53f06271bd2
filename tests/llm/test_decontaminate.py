import random
import re

import numpy as np
import pytest

from catalogkit.llm import decontaminate

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id int")


def brute(rows, items, share=0.8, least=13):
    """Best overlap over all alignments that have nine equal tokens in the shape of a mask."""
    found = {}
    for i, text in rows:
        words = WORD.findall((text or "").lower())
        for k, item in items:
            own = WORD.findall((item or "").lower())
            for shift in range(-len(own), len(words)):
                a, b = max(0, shift), min(len(words), shift + len(own))
                equal = np.array([x == y for x, y in zip(words[a:b], own[a - shift :])], bool)
                hit = any(
                    all(equal[p + q] for q, pick in enumerate(mask) if pick == "1")
                    for mask in decontaminate.MASKS for p in range(len(equal) - len(mask) + 1)
                )
                if hit:
                    begin, end = decontaminate.longest_overlap(equal, share)
                    if end - begin >= min(least, len(own)):
                        found[i, k] = max(found.get((i, k), (0, 0)), (end - begin, int(equal[begin:end].sum())))
    return found


def test_against_brute_force(documents, benchmark, odd_texts):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefg") + rng.choice("rst") + str(rng.randint(0, 9))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 50)))) for k in range(12)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            passage = rng.choice(items)[1].split()
            for p in range(rng.randint(1, 9), len(passage), rng.choice([5, 7, 3])):
                passage[p] = "changed"
            own[len(own) // 2 : len(own) // 2] = passage
        rows.append((i, ", ".join(own).upper() if i % 3 else " ".join(own)))
    rows += [(100 + i, t) for i, t in enumerate(odd_texts)]
    items += [(50, None), (51, ""), (52, odd_texts[-1])]
    got = decontaminate.overlaps(documents(rows).repartition(3), benchmark(items)).collect()
    expected = brute(rows, items)
    assert {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in got} == expected
    assert len(got) == len(expected) > 10


def test_one_word_in_five_may_differ(documents, benchmark):
    item = [f"t{i}" for i in range(30)]
    changed = [w if i % 5 else "other" for i, w in enumerate(item)]
    lost = [w if i % 2 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(changed)), (2, " ".join(lost)), (3, "The T1! t2? (t3)"), (4, "x. " + "; ".join(item))]
    got = decontaminate.overlaps(documents(rows), benchmark([(9, " ".join(item))])).collect()
    assert sorted((r.doc_id, r.doc_start) for r in got) == [(1, 0), (4, 1)] or sorted(r.doc_id for r in got) == [1, 4]


def test_ties_nulls_and_empty_tables(documents, benchmark):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, item), (1, item), (None, item)]
    got = decontaminate.overlaps(documents(rows), benchmark([(7, item), (8, item), (None, item), (7, item)])).collect()
    assert sorted(((r.doc_id or 0), (r.item_id or 0)) for r in got) == [(0, 0), (0, 7), (0, 8), (1, 0), (1, 7), (1, 8)]
    assert decontaminate.overlaps(documents([]), benchmark([(7, item)])).count() == 0
    assert decontaminate.overlaps(documents(rows), benchmark([])).count() == 0


def test_longest_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        equal = rng.random(rng.integers(0, 14)) < 0.7
        n = len(equal)
        best = max([b - a for a in range(n + 1) for b in range(a, n + 1) if equal[a:b].sum() >= 0.8 * (b - a) - 1e-9])
        a, b = decontaminate.longest_overlap(equal, 0.8)
        assert b - a == best and equal[a:b].sum() >= 0.8 * (b - a) - 1e-9
