"""Thinning, communities, splits and trees against their rules."""

import random
from collections import defaultdict

import numpy as np

from skein.operators import communities as CO
from skein.operators import hierarchy as H
from skein.operators import spatial as P
from skein.operators import vectors as V


def test_thinning_as_one_pass_in_order(spark):
    r = random.Random(3)
    pts = [(i, r.gauss(0, 50), r.gauss(0, 50), float(r.randrange(300))) for i in range(700)] + [(700, 2000.0, 2000.0, 1.0), (701, 0.0, 0.0, 1.0), (702, 0.0, 0.0, 1.0)]
    levels, divisor, top = 5, 40.0, 0.02
    got = {x.node: x.level for x in P.thin(spark.createDataFrame(pts, "node long, x double, y double, importance double"), levels, divisor, top).collect()}
    xs, ys, imp = (np.array([p[k] for p in pts]) for k in (1, 2, 3))
    span = max(xs.max() - xs.min(), ys.max() - ys.min())
    order, kept, level_of = sorted(range(len(pts)), key=lambda i: (-imp[i], i)), [], {}
    for level in range(levels):
        keep = min(1.0, top * 4**level)
        floor, radius = np.quantile(imp, 1 - keep) if keep < 1 else -1.0, span / divisor / 2**level
        for i in order:
            if i not in level_of and imp[i] >= floor and all((xs[i] - xs[j]) ** 2 + (ys[i] - ys[j]) ** 2 >= radius * radius for j in kept):
                kept.append(i)
                level_of[i] = level
        if len(level_of) == len(pts):
            break
    assert got == {i: level_of.get(i, level) for i in range(len(pts))}


def blobs(spark):
    """Two cliques of 18 and a weak bridge between them."""
    e = [(a, b, 1.0) for base in (0, 18) for a in range(base, base + 18) for b in range(a + 1, base + 18)] + [(8, 26, 0.05)]
    return spark.createDataFrame(e, "a long, b long, w double")


def test_communities_of_two_blobs_and_resolution(spark):
    w = blobs(spark)
    found = CO.communities(w)
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.label].add(r.node)
    assert dict(groups) == {0: set(range(18)), 18: set(range(18, 36))}
    q = CO.modularity(w, found)
    one = found.selectExpr("node", "0L as label")
    assert abs(q - 0.5) < 0.01 and abs(CO.modularity(w, one)) < 1e-9
    near, at = CO.communities_near(w, 2, 5)
    assert near.select("label").distinct().count() == 2 and at > 0
    assert CO.communities(w.limit(0)).collect() == []


def ring(spark, groups=6, size=30):
    """Unit vectors around some directions."""
    r = np.random.default_rng(5)
    rows = []
    for g in range(groups):
        c = r.normal(size=12)
        for i in range(size):
            v = c / np.linalg.norm(c) + 0.15 * r.normal(size=12)
            rows.append((g * size + i, (v / np.linalg.norm(v)).tolist()))
    return spark.createDataFrame(rows, "node long, v array<double>")


def check_tree(rows, nodes, least):
    cells, parents = defaultdict(set), {}
    for r in rows:
        assert r.node not in cells[r.level, r.cell]
        cells[r.level, r.cell].add(r.node)
        parents[r.level, r.cell] = r.parent
    assert sum(len(m) for (lv, _), m in cells.items() if lv == 0) == nodes == len(set().union(*[m for (lv, _), m in cells.items() if lv == 0]))
    by_parent = defaultdict(list)
    for (lv, c), m in cells.items():
        assert len(m) >= least
        if lv:
            assert m <= cells[lv - 1, parents[lv, c]]
            by_parent[lv - 1, parents[lv, c]].append(m)
    for p, parts in by_parent.items():
        assert len(parts) > 1 and sum(map(len, parts)) == len(cells[p]) and max(map(len, parts)) <= 0.68 * len(cells[p])
    return cells


def test_trees_keep_their_rules(spark):
    v = ring(spark)
    cells = check_tree(H.hierarchy(v, roots=6, branching=3, depth=3, least=5).collect(), 180, 5)
    assert len([1 for lv, _ in cells if lv == 0]) == 6
    w = V.exact_neighbours(v, v, 6, 2).selectExpr("node as a", "nbr as b", "greatest(score, 0.01D) as w")
    top = check_tree(H.hierarchy(v, H.by_graph(w, 3), roots=6, branching=2, depth=2, least=5).collect(), 180, 5)
    assert len([1 for lv, _ in top if lv == 0]) >= 4
    assert H.hierarchy(v.limit(0)).collect() == []


def test_fill_to_target_splits_the_largest(spark):
    v = ring(spark, 4, 20)
    m = v.selectExpr("0L as cell", "node", "v")
    out = H.fill_to_target(m, m.selectExpr("node", "cell", "0 as child"), 4, 8).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.child] += 1
    assert len(out) == 80 and len(sizes) == 4 and min(sizes.values()) >= 8
    few = H.fill_to_target(m.filter("node < 12"), m.filter("node < 12").selectExpr("node", "cell", "0 as child"), 4, 8).collect()
    assert {r.child for r in few} == {0}


def test_small_groups_go_to_the_nearest(spark):
    v = ring(spark, 2, 20)
    m = v.selectExpr("0L as cell", "node", "v")
    g = m.selectExpr("node", "cell", "case when node = 3 then 2 when node < 20 then 0 else 1 end as child")
    assert {r.node: r.child for r in H.attach_small(m, g, 5).collect()} == {i: int(i >= 20) for i in range(40)}
    assert H.attach_small(m.filter("node < 3"), g.filter("node < 3"), 5).collect() == []


def test_density_clusters_and_noise(spark):
    r = random.Random(1)
    pts = [(i, r.gauss(100 * (i % 2), 3), r.gauss(0, 3)) for i in range(200)] + [(200, 50.0, 50.0), (201, 500.0, 0.0)]
    got = {x.node: x.cluster for x in H.density_clusters(spark.createDataFrame(pts, "node long, x double, y double"), 4.0, 5, 20).collect()}
    assert got[200] == got[201] == -1 and len({c for c in got.values() if c >= 0}) == 2
    assert len({got[i] for i in range(0, 200, 2)} - {-1}) == 1


def test_search_by_cells_finds_nine_tenths(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["e3_e24_approximate_recall"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.hits for r in rows) >= 0.9 * sum(r.wanted for r in rows)
