"""Hierarchical density clusters against a sequential statement of the same rules."""

import math
import random

import numpy as np

from skein.operators import density as D
from skein.operators import forest as F_
from skein.operators.forest import chains, scanned, spanning_rounds


def make(n, seed=3):
    r = random.Random(seed)
    spots = [(0, 0, 1.0), (12, 1, 0.4), (12.5, 4.5, 0.5), (-9, 8, 2.0), (30, 30, 0.05)]
    out = []
    for k in range(n):
        x, y, s = spots[k % 5]
        out.append((k * 7 % 100_003, r.gauss(x, s), r.gauss(y, s)) if k % 9 else (k * 7 % 100_003, r.uniform(-30, 40), r.uniform(-30, 40)))
    return out


def sequential(points, least_near, least_size, single=False):
    """All pairs, Kruskal, the condensed tree from the root down, and excess of mass."""
    ids, n = [p[0] for p in points], len(points)
    d = {(i, j): math.sqrt((points[i][1] - points[j][1]) ** 2 + (points[i][2] - points[j][2]) ** 2) for i in range(n) for j in range(i)}
    dist = lambda i, j: d[max(i, j), min(i, j)]
    core = [sorted(dist(i, j) for j in range(n) if j != i)[min(least_near, n - 1) - 1] for i in range(n)]
    edges = sorted((max(x, core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for (i, j), x in d.items())
    top, kids, size, weight = list(range(n)), {}, [1] * n, [0.0] * n
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for w, _, _, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            node = len(size)
            kids[node] = (top[a], top[b])
            size.append(size[top[a]] + size[top[b]])
            weight.append(w)
            root[b] = a
            top[a] = node
    under = lambda x: [x] if x < n else [z for y in kids[x] for z in under(y)]
    import sys
    sys.setrecursionlimit(100_000)
    clusters, todo = [], [(len(size) - 1, 0.0, None)]
    if size[-1] < least_size or n < 2:
        return dict.fromkeys(ids, -1)
    while todo:
        node, birth, parent = todo.pop()
        me = len(clusters)
        c = {"parent": parent, "birth": birth, "stability": 0.0, "fallen": [], "kids": [], "node": node}
        clusters.append(c)
        if parent is not None:
            clusters[parent]["kids"].append(me)
        while True:
            at = 1 / max(weight[node], 1e-12)
            a, b = kids[node]
            large = [x for x in (a, b) if size[x] >= least_size]
            if len(large) == 2:
                c["stability"] += size[node] * (at - birth)
                todo += [(a, at, me), (b, at, me)]
                break
            for x in (a, b):
                if x not in large:
                    c["stability"] += size[x] * (at - birth)
                    c["fallen"] += under(x)
            if not large:
                break
            node = large[0]
    value = {}
    for k in range(len(clusters) - 1, -1, -1):
        inside = sum(value[x] for x in clusters[k]["kids"])
        clusters[k]["able"] = clusters[k]["stability"] >= inside and (k > 0 or single)
        value[k] = max(clusters[k]["stability"], inside)
    label = dict.fromkeys(ids, -1)
    for k, c in enumerate(clusters):
        best, x = None, k
        while x is not None:
            best = x if clusters[x]["able"] else best
            x = clusters[x]["parent"]
        if best is not None:
            name = min(ids[i] for i in under(clusters[best]["node"]))
            for i in c["fallen"]:
                label[ids[i]] = name
    return label


def test_hierarchy_is_that_of_all_pairs(spark):
    n, least_near, least_size = 1500, 6, 20
    points = make(n)
    want = sequential(points, least_near, least_size)
    got = {r.node: r.cluster for r in D.density_hierarchy(spark.createDataFrame(points, "node long, x double, y double"), least_near, least_size).collect()}
    assert got == want
    assert len(set(want.values())) > 4 and -1 in want.values()


def test_small_and_single(spark):
    points = make(40, 5)
    df = spark.createDataFrame(points, "node long, x double, y double")
    assert {r.node: r.cluster for r in D.density_hierarchy(df, 3, 10, True).collect()} == sequential(points, 3, 10, True)
    assert D.density_hierarchy(df.limit(0), 3, 5).collect() == []
    assert {r.cluster for r in D.density_hierarchy(df.limit(1), 3, 5).collect()} == {-1}


def test_forest_and_sizes(spark):
    r = random.Random(8)
    n = 300
    edges = [(a, b, r.random()) for a in range(n) for b in (r.randrange(n), (a + 1) % n) if a // 100 == b // 100]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    rounds = spanning_rounds(spark.range(n).withColumnRenamed("id", "node"), df)
    root, size, want = list(range(n)), [1] * n, {}

    def find(i):
        return i if root[i] == i else find(root[i])

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            root[y], size[x] = x, size[x] + size[y]
            want[a, b] = (w, size[x])
    got = {(x.a, x.b): (x.w, x.size) for x in scanned(chains(rounds), 5).collect()}
    assert got == want
    assert {(x.a, x.b) for x in rounds.edges().collect()} == set(want)


def test_lists_are_thinned_before_the_rounds(spark, monkeypatch):
    rows, real = [], F_.staged
    monkeypatch.setattr(F_, "staged", lambda df, name, **k: (out := real(df, name, **k), rows.append(out.count() if name == "forest-edges" else 0))[0])
    points, n = make(600, 9), 600
    got = {r.node: r.cluster for r in D.density_hierarchy(spark.createDataFrame(points, "node long, x double, y double"), 6, 15).collect()}
    assert got == sequential(points, 6, 15)
    assert max(rows) < 2 * n  # a list has ten


def test_least_forest_of_equal_weights():
    r = random.Random(5)
    for n, m in ((1, 0), (2, 3), (40, 30), (60, 400)):
        edges = [(min(x), max(x), float(r.randrange(6))) for x in (r.sample(range(n), 2) for _ in range(m))]
        root, want = list(range(n)), set()

        def find(i):
            return i if root[i] == i else find(root[i])  # noqa: B023

        for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
            if (x := find(a)) != (y := find(b)):
                root[x] = y
                want.add((a, b, w))
        a, b, w = (np.array([e[k] for e in edges], t) for k, t in enumerate((np.int64, np.int64, float)))
        at = F_.least_forest(a, b, w)
        assert {(int(a[k]), int(b[k]), float(w[k])) for k in at} == want and len(at) == len(want)


def test_no_frame_of_a_chain_is_evaluated_anew_for_each_row(spark, monkeypatch):
    plans, real = [], F_.staged
    monkeypatch.setattr(F_, "staged", lambda df, name, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower()), real(df, name, **k))[1])
    n = 40
    df = spark.createDataFrame([(k, k + 1, float(k)) for k in range(n)], "a long, b long, w double")
    got = {x.a: (x.size, x.above.a if x.above else None) for x in scanned(chains(spanning_rounds(spark.range(n + 1).withColumnRenamed("id", "node"), df)), 1).collect()}
    assert got == {k: (k + 2, k + 1 if k + 1 < n else None) for k in range(n)}
    assert any("unboundedpreceding" in p for p in plans) and not any("unboundedfollowing" in p for p in plans)
