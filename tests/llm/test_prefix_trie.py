import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from catalogkit.llm import prefix_trie, tree_sums
from catalogkit.session import cut_lineage

SCHEMA = "conv_id long, turn long, role string, text string, id string, part int, depth string, n_convs string, size int"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        n = crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - c % 100, [])[:n] + v[n:])
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    ended = lambda node, own: ",".join(str(c) for c in own if len(convs[c]) == len(node))
    return [
        (own[0], len(node), members[node[:-1]][0] if node else None, len(own), children[node], leaves[node], saved[node],
         sha256(ended(node, own).encode()).hexdigest())
        for node, own in members.items()
    ]


def check(spark, rows):
    given = spark.createDataFrame([(*r, "x", 1, "y", "z", 3) for r in rows], SCHEMA)
    got = prefix_trie.trie(given.repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def conversations(n, seed, longest=6, words=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), "é" * rng.randint(0, words)) for c in range(n) for t in range(rng.randint(0, longest))]


@pytest.mark.parametrize("most", [1 << 14, 30, 1])
def test_against_brute_force(spark, monkeypatch, most):
    """Also with components so small that tables are split many times before a task gets one."""
    monkeypatch.setattr(tree_sums, "MOST_LOCAL", most)
    check(spark, conversations(150, most))


def test_odd_rows(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_CHARS", 10)
    rows = [(c, t, None if t % 2 else "u", text) for c in (3, 250, -70) for t, text in enumerate(odd_texts)]
    rows += [(5, None, "u", "first"), (5, None, "u", "also"), (5, 1, "u", "same"), (5, 1, "u", "same"), (5, -1, None, None)]
    rows += [(None, 1, "u", "no conversation"), (None, None, None, None), (401, 0, "u", "no base"), (402, 1, None, "")]
    rows += [(c, 0, "u", "a copy") for c in range(1000, 1080)]
    check(spark, rows)


def test_long_conversation_over_several_partitions(spark, monkeypatch):
    """A conversation that holds most turns is dealt out, and its prefixes are still one chain."""
    rng, laid = random.Random(1), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(prefix_trie, "cut_lineage", lambda df: laid.append(cut_lineage(df)) or laid[-1])
    rows = [(200, t, "u", "ab"[rng.random() < 0.5]) for t in range(1500)] + [(201, t, "u", "c") for t in range(40)]
    steps = prefix_trie.prefixes(prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert steps.filter("conv = 200").select("id").distinct().count() == 1501
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert any("x0" in df.columns and df.filter("conv = 200").select(F.spark_partition_id()).distinct().count() > 1 for df in laid)
    pairs = {(r.depth, r.id, r.parent) for r in steps.filter("conv = 200").collect()}
    ids = {d: i for d, i, _ in pairs}
    assert all(parent == ids.get(depth - 1) for depth, _, parent in pairs)
    check(spark, rows)


def test_no_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_local_sums():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randint(1, 60)
        parents = [-1] + [rng.randint(max(0, i - rng.choice([1, 3, 60])), i - 1) for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parents[i]] + 1
        order = sorted(range(n), key=depth.__getitem__)
        spot = {v: k for k, v in enumerate(order)}
        parents = [spot.get(parents[v], -1) for v in order]
        values = [(rng.randint(0, 9), 1) for _ in order]
        expected = [list(v) for v in values]
        for v in reversed(range(1, n)):
            expected[parents[v]] = [a + b for a, b in zip(expected[parents[v]], expected[v])]
        assert tree_sums.local_sums(parents, values) == expected


@pytest.mark.parametrize("most", [1 << 14, 5])
def test_forest_sums(spark, most):
    """Several trees at once, a chain, a star and random ones, with weights other than sizes."""
    rng, parent = random.Random(4), {}
    shapes = {"chain": lambda k: k - 1, "star": lambda k: 0, "tree": lambda k: rng.randrange(k), "single": None}
    for name, shape in shapes.items():
        for k in range(40 if shape else 1):
            parent[f"{name}{k}"] = f"{name}{shape(k)}" if k else None
    own = {v: (rng.randint(0, 9), rng.randint(-5, 5), rng.randint(1, 4)) for v in parent}
    above = {v: [v] for v in parent}
    for v, line in above.items():
        while parent[line[-1]]:
            line.append(parent[line[-1]])
    sums = {v: [sum(own[u][k] for u in parent if v in above[u]) for k in range(3)] for v in parent}
    nodes = [(v, p, len(above[v]) - 1, v, sums[v][2], own[v][0], own[v][1]) for v, p in parent.items()]
    steps = [(v, len(above[u]) - 1, u, parent[u]) for v in parent for u in above[v]]
    found = tree_sums.subtree_sums(
        spark.createDataFrame(nodes, "id string, parent string, depth long, line string, weight long, a long, b long"),
        spark.createDataFrame(steps, "line string, depth long, id string, parent string"), ["a", "b"], most,
    )
    assert {r.id: [r.a, r.b] for r in found.collect()} == {v: s[:2] for v, s in sums.items()}
