import numpy as np
import pytest

from catalogkit.llm import cover_tree


def brute(rows, threshold=0.9):
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label, links = {i: i for i, _ in rows if i is not None}, dict.fromkeys((i for i, _ in rows if i is not None), 0)
    pairs = []
    for a, x in sound.items():
        for b, y in sound.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a] += 1
                pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[b] < label[a]:
                label[a], changed = label[b], True
    return {i: (links[i], label[i], label[i] == i) for i in label}


@pytest.mark.parametrize("block,cell", [(3072, 8192), (40, 60)])
def test_against_brute_force(spark, monkeypatch, block, cell):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "CELL_ROWS", cell)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = [base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1, 0.25]) for i in range(240)]
    chain = [np.append([np.cos(t), np.sin(t)], np.zeros(14)) for t in np.arange(0, 2, 0.3)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near, *chain, *[base[0]] * 30])]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [None] * 16), (n + 4, [float("nan")] * 16)]
    rows += [(n + 5, [float("inf")] + [0.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.0]), (n + 8, (base[1] * 1e-30).tolist()), (n + 9, [1e38] * 16)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect()}
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_a_crowd_is_settled_by_ranges():
    rng = np.random.default_rng(2)
    x = cover_tree.scaled(rng.normal(size=8) + rng.normal(size=(2000, 8)) * 0.01)
    tree = cover_tree.Tree(x, cover_tree.widest_net(0.9))
    ranges, (left, _) = cover_tree.linked(tree, tree, 0.9)
    assert len(left) == 0 and sum((q - p) * (s - r) for p, q, r, s in ranges.tolist()) == 2000 * 2000
    assert len(ranges) < 50


def test_rows_without_id_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    got = cover_tree.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])], schema)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 0, None, False), (4, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True)], key=repr)
    assert cover_tree.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_columns_named_like_results_are_ignored(spark):
    names = ["n_links", "component_id", "kept", "vector", "rep", "copies", "part"]
    rows = [(i, [1.0, 0.1 * (i % 2)], *[f"{name} {i}" for name in names]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"{name} string" for name in names))
    found = cover_tree.near_duplicates(df)
    assert {"vec_id", "n_links", "component_id", "kept"} <= set(found.columns)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == [(i, 3, 0, i == 0) for i in range(4)]
