"""Every pattern of the stated tolerance is found, by brute force that knows no masks."""

import random
from itertools import combinations

import numpy as np

from catalogkit.llm import decontaminate

from .test_decontaminate import benchmark  # noqa: F401


def test_every_pattern_is_hit():
    """No string that avoids all masks has 13 tokens with 80 % equal.

    One of 26 or more splits into parts of 13 to 25, one of which would be as equal.
    """
    masks = [int(m, 2) for m in decontaminate.LONG_MASKS]
    states = {0: 0}
    keep = (1 << max(len(m) for m in decontaminate.LONG_MASKS)) - 1
    for n in range(1, 60):
        after = {}
        for state, score in states.items():
            for bit in (0, 1):
                new = ((state << 1) | bit) & keep
                if not any(new & m == m for m in masks):
                    after[new] = max(after.get(new, -1000), score + (1 if bit else -4))
        states = after
        assert n < 13 or max(states.values()) < 0
    for n, own in decontaminate.SHORT_MASKS.items():
        for changed in combinations(range(n), n // 5):
            assert any(all(p + q not in changed for q, x in enumerate(m) if x == "1") for m in own for p in range(n - len(m) + 1))


def brute(rows, items):
    found = {}
    for i, text in rows:
        words = text.split()
        for k, item in items:
            own = item.split()
            for shift in range(1 - len(own), len(words)):
                a, b = max(0, shift), min(len(words), shift + len(own))
                equal = np.array([x == y for x, y in zip(words[a:b], own[a - shift :])], bool)
                begin, end = decontaminate.longest_overlap(equal, 0.8)
                if end - begin >= min(13, len(own)):
                    found[i, k] = max(found.get((i, k), (0, 0)), (end - begin, int(equal[begin:end].sum())))
    return found


def test_changed_words_against_brute_force(documents, benchmark):  # noqa: F811
    rng = random.Random(4)
    items, rows = [], []
    for n in (*range(1, 14), 15, 16, 20):
        item = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        patterns = list(combinations(range(n), n // 5))
        for changed in rng.sample(patterns, min(len(patterns), 80)):
            own = ["x" if j in changed else w for j, w in enumerate(item)]
            rows.append((len(rows), " ".join([*[f"a{j}" for j in range(rng.randint(0, 5))], *own, *[f"b{j}" for j in range(rng.randint(0, 5))]])))
    rows += [(9000 + n, " ".join(t.split()[:-1] or ["none"]).replace("w1", "x")) for n, t in items]
    got = decontaminate.overlaps(documents(rows).repartition(3), benchmark(items)).collect()
    expected = brute(rows, items)
    assert {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in got} == expected
    assert len(got) == len(expected) >= len(rows) - len(items)
