"""Nearest points on maps that are crowded in one spot."""

import numpy as np

from skein.operators import nearest as N


def test_crowded_map(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 60)
    monkeypatch.setattr(N, "SAMPLE", 900)
    r = np.random.default_rng(6)
    p = np.concatenate([r.uniform(-50, 50, (200, 2)), r.normal(10, 0.01, (1800, 2)), np.full((300, 2), 10.0), np.full((40, 2), -3.5)])
    ids = r.permutation(len(p)) * 5 - 4000
    df = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, p)], "node long, x double, y double")
    got = {}
    for q in N.nearest_points(df, 6).collect():
        got.setdefault(q.a, {})[q["rank"]] = (q.b, q.d2)
    d2 = (p[:, 0, None] - p[None, :, 0]) ** 2 + (p[:, 1, None] - p[None, :, 1]) ** 2
    assert len(got) == len(p)
    for i in range(0, len(p), 3):
        order = [j for j in np.lexsort((ids, d2[i])) if j != i][:6]
        assert [got[ids[i]][k + 1] for k in range(6)] == [(ids[j], d2[i, j]) for j in order]


def test_work_does_not_grow_with_the_crowd(spark):
    """Nine tenths of the points in a spot, yet no leaf has many more places than another."""
    r = np.random.default_rng(7)
    p = np.concatenate([r.normal(0, 1e-4, (9000, 2)), r.uniform(-100, 100, (1000, 2))])
    tree = N.Tree(p, 100)
    _, leaf = tree.leaves(p, np.zeros(len(p)))
    assert len(leaf) == len(p) and max(np.bincount(leaf)) <= 100


def test_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 5.0, 0.0)], "node long, x double, y double")
    assert {(q.a, q.b, q["rank"]) for q in N.nearest_points(df, 9).collect()} == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
    assert N.nearest_points(df.limit(1), 2).collect() == [] and N.nearest_points(df.limit(0), 2).collect() == []
