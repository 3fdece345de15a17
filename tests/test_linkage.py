"""Average linkage against the sequential algorithm, exact search in blocks against plain products."""

import numpy as np
from pyspark.sql import functions as F

from skein.operators import linkage as K
from skein.operators import vectors as V


def unit(n, dim, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(6, dim))[r.integers(0, 6, n)] + 0.5 * r.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def sequential(v):
    """(names, height) of each merge: the least mean distance first, distances updated by Lance and Williams."""
    n = len(v)
    d = {(i, j): 1 - float(v[i] @ v[j]) for i in range(n) for j in range(i + 1, n)}
    size, out = dict.fromkeys(range(n), 1), []
    while len(size) > 1:
        (a, b), h = min(d.items(), key=lambda x: (x[1], x[0]))
        out.append((a, b, h))
        for c in size:
            if c not in (a, b):
                x, y = d.pop((min(a, c), max(a, c))), d.pop((min(b, c), max(b, c)))
                d[min(a, c), max(a, c)] = (size[a] * x + size[b] * y) / (size[a] + size[b])
        del d[a, b]
        size[a] += size.pop(b)
    return out


def test_tree_and_cut_are_those_of_the_sequential_algorithm(spark):
    v = unit(30, 8, 3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, v array<double>").coalesce(2).cache()
    want = sequential(v)
    got = {(r.a, r.b): r.height for r in K.merges(df).collect()}
    assert got.keys() == {(a, b) for a, b, _ in want} and all(abs(got[a, b] - h) < 1e-6 for a, b, h in want)
    name = list(range(30))
    for a, b, _ in want[: 30 - 7]:
        name = [a if x == b else x for x in name]
    assert {r.node: r.cluster for r in K.coarsened(df, 7).collect()} == {i: min(j for j in range(30) if name[j] == name[i]) for i in range(30)}
    assert K.merges(df.limit(0)).collect() == []


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    monkeypatch.setattr(V, "QUERIES", 16)
    v = unit(230, 6, 5).astype(np.float32)
    v[100:160] = v[100]  # equal vectors: least ids win
    df = spark.createDataFrame([(i * 2, x.tolist()) for i, x in enumerate(v)], "node long, v array<float>")
    got = {}
    for r in V.exact_neighbours(df.filter("node % 3 = 0"), df, 9).collect():
        got.setdefault(r.node, {})[r["rank"]] = (r.nbr, r.score)
    assert set(got) == {i * 2 for i in range(230) if i * 2 % 3 == 0}
    for q, found in got.items():
        s = np.round(v.astype(float) @ v[q // 2].astype(float), 5)
        order = [j for j in sorted(range(230), key=lambda j: (-s[j], j)) if j != q // 2][:9]
        assert [found[k + 1][0] for k in range(9)] == [2 * j for j in order] and all(abs(found[k + 1][1] - s[j]) < 1e-9 for k, j in enumerate(order))
    assert V.exact_neighbours(df.limit(0), df, 3).collect() == [] and V.exact_neighbours(df.limit(1), df.limit(1), 3).select(F.col("node")).collect() == []
