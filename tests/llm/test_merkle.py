import random
from hashlib import sha256
from zlib import crc32

import pytest

from catalogkit.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, size int, leaf string, digest string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    """Root, and for each node the (left, right) siblings on the way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run, k = nodes[at[i] // 8 * 8 :][:8], at[i] % 8
            path.append((run[:k], run[k + 1 :]))
            at[i] //= 8
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((own, *grown([leaf(*r) for r in own])))
    if not trees:
        return []
    root, tops = grown([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0
            back = leaf(r[0], lower(r[1]), *r[2:]) if hit else leaf(*r)
            for a, b in path + top:
                back = h("".join(a) + back + "".join(b))
            out.append((r[0], leaf(*r), subroot, root, h("".join(x for a, b in path + top for x in a + b)), back, back == root))
    return out


def check(spark, rows):
    given = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA)
    got = merkle.manifest(given.repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9, 1], [65, 64, 3], [520, 4]])
def test_against_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randint(0, 10**6), f"Text {rng.random()}", f"l{k}", "s", 5) for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark, odd_texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(odd_texts)]
    rows += [(i, t, lang, "s", 1) for i, t in enumerate(odd_texts) for lang in ("", "é", "日本", "Z", "a", "=")]
    rows += [(None, "Null ID", "en", "s", 1)] * 3 + [(7, "SAME", "en", "s", 1)] * 20 + [(-3, "Below", "en", None, -1)]
    rows += [(i, "T", f"many{i:03}", "s", 1) for i in range(70)]
    check(spark, rows)


def test_more_blocks_than_one_round(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    monkeypatch.setattr(merkle, "steps", lambda size, most=1: int(size > 1))
    check(spark, [(i, f"Text {i}", "hot" if i % 3 else f"l{i % 30}", "s", i) for i in range(300)])


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_proof_binds_its_leaf():
    block = merkle.Block(0, [h(str(i)) for i in range(20)], 2)
    for place, proof in block.proofs(("", "", "")):
        assert merkle.folded(h(str(place)), *proof) == block.digests[block.top]
        assert merkle.folded(h("other"), *proof) != block.digests[block.top]
