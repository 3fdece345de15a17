"""Refined communities: connected, and no worse than those without refinement."""

import random

from skein.operators.communities import communities, components, connected_parts, modularity, refined_communities


def graph(seed, groups, size, inner, outer):
    r = random.Random(seed)
    n = groups * size
    return [(a, b, round(r.uniform(0.5, 2), 3)) for a in range(n) for b in range(a) if r.random() < (inner if a // size == b // size else outer)]


def pieces(edges, label):
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        if label[a] == label[b]:
            root[find(a)] = find(b)
    return {x: find(x) for x in label}


def test_connected_and_no_worse(spark):
    edges = graph(2, 4, 20, 0.12, 0.015)
    df = spark.createDataFrame(edges, "a long, b long, w double").coalesce(1).cache()
    before = communities(df, rounds=6)
    got = refined_communities(df, rounds=6, levels=2, start=before)
    label = {r.node: r.label for r in got.collect()}
    parts = pieces(edges, label)
    assert all(len({parts[x] for x in label if label[x] == c}) == 1 and min(x for x in label if label[x] == c) == c for c in set(label.values()))
    assert label.keys() == {x for e in edges for x in e[:2]}
    assert modularity(df, got) >= modularity(df, before) - 1e-9


def test_a_disconnected_community_comes_apart(spark):
    """Two cliques that a bridge node once joined have one label, the bridge another: moves alone leave them together, as each node's neighbours are all of its label."""
    clique = lambda lo: [(a, b, 1.0) for a in range(lo, lo + 6) for b in range(lo, a)]
    edges = [*clique(0), *clique(10), *clique(20), (5, 30, 0.6), (10, 30, 0.6), (20, 30, 1.5), (21, 30, 1.5)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    nodes = {x for e in edges for x in e[:2]}
    start = spark.createDataFrame([(x, 20 if x >= 20 else 0) for x in nodes], "node long, label long")
    found = refined_communities(df, start=start, rounds=6)
    got = {r.node: r.label for r in found.collect()}
    assert {got[x] for x in range(6)} == {0} and {got[x] for x in range(10, 16)} == {10} and got[30] == got[20] == 20
    assert {r.node: r.label for r in connected_parts(df, start).collect()} == {x: 20 if x >= 20 else 10 if x >= 10 else 0 for x in nodes}
    assert modularity(df, found) > modularity(df, start)


def test_nothing_and_pairs(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (5, 5, 2.0), (6, 7, 0.0)], "a long, b long, w double")
    assert {r.node: r.label for r in refined_communities(df, rounds=4).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert refined_communities(df.limit(0)).collect() == []
    assert {r.comp for r in components(df.filter("a = 1").select("a", "b")).collect()} == {1}
