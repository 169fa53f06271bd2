import random
import re

import xxhash

from catalogkit.llm import simhash
from catalogkit.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints, differing=4):
    """Smallest id reachable over links, by brute force."""
    label = dict(enumerate(range(len(prints))))
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (prints[a] ^ prints[b]).bit_count() <= differing and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_against_brute_force(documents, odd_texts):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(120)) for _ in range(6)]
    texts = []
    for t in base * 6:
        words = t.split()
        words[rng.randrange(len(words))] = "NEW"
        texts.append(" ".join(words))
    texts += odd_texts + base
    prints = [fingerprint(t) for t in texts]
    label = groups(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(list(enumerate(texts)))).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == [label[i] for i in range(len(texts))]


def test_crowded_blocks_are_cut_without_losing_links(spark):
    """Fingerprints in one chain of single-bit steps: all in a few crowded block values."""
    rng = random.Random(2)
    value, prints = rng.getrandbits(64), set()
    for _ in range(300):
        value ^= 1 << rng.randrange(12)
        prints.add(value)
    far = {p ^ (0x1F << 50) for p in prints}
    rows = [(simhash.signed(p),) for p in prints | far]
    found = components(simhash.links(spark.createDataFrame(rows, "fingerprint long"), tile=16))
    by_node = {r.node: r.component for r in found.collect()}
    assert len({by_node[simhash.signed(p)] for p in prints}) == 1
    assert len({by_node[simhash.signed(p)] for p in far}) == 1
    assert by_node[simhash.signed(min(prints))] != by_node[simhash.signed(min(far))]


def test_rows_without_id_and_repeated_rows(documents):
    got = simhash.near_duplicates(documents([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_components_of_hubs_and_chains(spark):
    edges = [(0, i) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (300, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(50)} == {0}
    assert {found[i] for i in range(100, 161)} == {100}
    assert 300 not in found
