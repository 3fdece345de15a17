"""Joins whose pairs are many more than their rows: right, and without what is made of each pair being shuffled or staged."""

import numpy as np
import pyarrow as pa

from skein.operators import client as CL
from skein.operators import labels as LB
from skein.operators import lookups as L
from skein.operators import spatial as P
from skein.operators import vectors as V
from skein.sources import staging


def top(df):
    """The uppermost node of the plan, a projection aside."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return next(x.strip(" +-:") for x in lines if "Project" not in x)


def test_crosswalk_pairs_are_not_shuffled(spark):
    c = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, None)], "node long, k long")
    ids = spark.createDataFrame([(10, 7), (11, 7), (11, 7), (12, None)], "other long, k long")
    df = L.crosswalk(c, ids, "k")
    assert sorted(map(tuple, df.collect())) == [(1, 10), (1, 11), (2, 10), (2, 11)] and top(df).startswith("Join")
    two = spark.createDataFrame([(1, 7), (1, 8)], "node long, k long"), spark.createDataFrame([(10, 7), (10, 8)], "other long, k long")
    assert list(map(tuple, L.crosswalk(*two, "k").collect())) == [(1, 10)]


def test_redundant_pairs_are_not_shuffled(spark):
    texts = ["red blue", "blue red", "red", "red red", "green", "", "a b c d e f g h i j", "a b c d e f g h i k", "j i h g f e d c b a"]
    df = LB.redundant_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    sets = [set(t.split()) for t in texts]
    want = sorted((i, j) for j in range(len(texts)) for i in range(j) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 9 * min(len(sets[i]), len(sets[j])))
    assert sorted(map(tuple, df.select("a", "b").collect())) == want and top(df).startswith("Join")


def test_counts_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "CROWD", 30)
    monkeypatch.setattr(P, "PAIRS", 500)
    r = np.random.default_rng(5)
    p = np.concatenate([r.uniform(-20, 20, (150, 2)), r.normal(3, 0.2, (200, 2)), np.full((40, 2), 6.0), [[6.0, 7.0], [500.0, 0.0]]])
    df = spark.createDataFrame([(k * 3, float(x), float(y)) for k, (x, y) in enumerate(p)], "node long, x double, y double")
    d2 = (p[:, 0, None] - p[None, :, 0]) ** 2 + (p[:, 1, None] - p[None, :, 1]) ** 2
    n = (d2 < 1.0).sum(1) - 1
    assert {x.a: x.n for x in P.counts_within(df, df, 1.0).collect()} == {k * 3: int(c) for k, c in enumerate(n) if c}


def test_labels_of_one_text_are_not_paired(spark, monkeypatch):
    rows, real = [], staging.staged
    monkeypatch.setattr(staging, "staged", lambda df, name, **k: (out := real(df, name, **k), rows.append(out.count()))[0])
    labels = spark.range(600).selectExpr("id", "concat('t', id % 2) AS text", "100.0D + id % 7 AS px", "100.0D + id % 5 AS py", "12.0D AS size", "cast(id % 50 AS double) AS priority")
    assert [x.id for x in CL.declutter(labels, 500.0, 400.0).collect()] == [49]
    assert sum(rows) < 3000


def test_redundant_pairs_of_one_set_are_dealt(spark, monkeypatch):
    """Two texts that all labels have, one within the other: every pair once, in tasks of which none holds a set."""
    monkeypatch.setattr(LB, "BLOCK", 16)
    monkeypatch.setattr(LB, "PAIRS", 500)
    df = LB.redundant_pairs(spark.range(300).selectExpr("id * 3 AS id", "if(id % 3 = 0, 'red', 'red blue') AS text"))
    got = df.selectExpr("a", "b", "spark_partition_id() AS p").collect()
    assert sorted((r.a, r.b) for r in got) == [(a * 3, b * 3) for a in range(300) for b in range(a + 1, 300)]
    tasks = [sum(r.p == p for r in got) for p in {r.p for r in got}]
    assert len(tasks) > 8 and max(tasks) < 300 * 299 // 2 // 8


def test_crosswalk_of_one_key_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS", 1000)
    c, ids = spark.range(400).selectExpr("id AS node", "if(id < 390, 7, 8) AS k"), spark.range(50).selectExpr("id AS other", "if(id < 49, 7, 8) AS k")
    got = L.crosswalk(c, ids, "k").selectExpr("*", "spark_partition_id() AS p").collect()
    assert sorted((r.node, r.other) for r in got) == sorted([(n, o) for n in range(390) for o in range(49)] + [(n, 49) for n in range(390, 400)])
    tasks = [sum(r.p == p for r in got) for p in {r.p for r in got}]
    assert len(tasks) > 8 and max(tasks) < len(got) // 3


def test_lists_of_parts_are_not_all_kept(spark, monkeypatch):
    """Vectors pass by a task's queries in batches, and only the best of all leave it: rows grow with the queries, not with queries times blocks."""
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "HELD", 50)
    monkeypatch.setattr(V, "TASKS", 2)
    monkeypatch.setattr(V, "AT_ONCE", 7)
    x = np.random.default_rng(2).normal(size=(400, 5)).round(2)
    x[1::9] = x[0]
    df = spark.createDataFrame([(k * 2, r.tolist()) for k, r in enumerate(x)], "node long, v array<double>")
    rows = [(part, kind, k * 2, x[k].tolist()) for part in (0, 1) for kind in (0, 1) for k in range(400) if kind or k % 2 == part]
    batch = pa.RecordBatch.from_pydict({n: [r[c] for r in rows] for c, n in enumerate(("part", "kind", "node", "v"))})
    assert sum(len(b) for b in V._best_in_passing(6, 5)(batch.slice(i, 30) for i in range(0, len(rows), 30))) == 400 * 6
    s = np.round(x @ x.T, 5)
    want = {2 * i: [(2 * int(j), s[i, j]) for j in sorted(range(400), key=lambda j: (-s[i, j], j)) if j != i][:6] for i in range(400)}
    got = {}
    for r in V.passing_neighbours(df, df, 6).orderBy("node", "rank").collect():
        got.setdefault(r.node, []).append((r.nbr, r.score))
    assert {k: [b for b, _ in v] for k, v in got.items()} == {k: [b for b, _ in v] for k, v in want.items()}
    assert all(abs(p[1] - w[1]) < 1e-9 for k in got for p, w in zip(got[k], want[k], strict=True))
