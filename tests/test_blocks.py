"""Vectors that meet block by block: ranks of gold answers, search in cells, and groups that are cut by their own size."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from skein.operators import stats as ST
from skein.operators import vectors as V


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def make(spark, n, dims=6, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, dims)).round(3).astype(np.float32)
    x[1::7] = x[0]
    return x, spark.createDataFrame([(k, x[k].tolist()) for k in range(n)], "node bigint, v array<float>")


def in_order(a, b):
    s = 0.0
    for p, q in zip(a.astype(float), b.astype(float), strict=True):
        s += p * q
    return s


def test_gold_ranks_in_blocks(spark):
    x, df = make(spark, 300)
    queries = df.filter("node % 5 = 0").select("node", F.col("v").alias("q")).join(df.select((F.col("node") - 1).alias("node"), F.col("v").alias("g")), "node")
    found = ST.gold_ranks(queries, df.union(spark.createDataFrame([(900, None), (901, [None] * 6)], df.schema)), blocks=3)
    got = {r.node: r["rank"] for r in found.collect()}
    s = [[round(in_order(a, b), 5) for b in x] for a in x]
    assert got == {k: 1 + sum(s[k][j] > s[k][k + 1] for j in range(300) if j != k) for k in range(0, 300, 5) if k < 299}
    assert "FlatMapCoGroupsInArrow" in plan(found)  # no row a pair


def test_gold_rank_of_a_score_that_rounds_down_to_gold(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.00002, 0.0]), (2, [0.0000249, 0.0]), (3, [0.0000251, 0.0]), (4, [0.000025, 0.0])], "node bigint, v array<double>")
    queries = df.filter("node = 0").select("node", F.col("v").alias("q")).join(df.filter("node = 1").select(F.lit(0).cast("bigint").alias("node"), F.col("v").alias("g")), "node")
    assert [(r.node, r["rank"]) for r in ST.gold_ranks(queries, df).collect()] == [(0, 3)]  # halves go up, as in SQL
    none = queries.select("node", "q", F.lit(None).cast("array<double>").alias("g"))
    assert [(r.node, r["rank"]) for r in ST.gold_ranks(none, df).collect()] == [(0, 1)]


def test_cells_are_searched_in_blocks(spark):
    x, df = make(spark, 200)
    cells = [x[k].astype(float).tolist() for k in (0, 2, 3, 4)]
    c = np.array(cells)
    order = np.argsort((c * c).sum(1)[None] / 2 - x.astype(float) @ c.T, axis=1, kind="stable")
    found = V.approximate_neighbours(df.filter("node % 10 = 0"), df, cells, 4, 2)
    assert "FlatMapCoGroupsInArrow" in plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.node, {})[r["rank"]] = (r.nbr, r.score)
    for k in range(0, 200, 10):
        near = sorted((-round(in_order(x[k], x[j]), 5), j) for j in range(200) if j != k and order[j, 0] in order[k, :2])[:4]
        assert [got[k][i + 1] for i in range(len(near))] == [(j, -s) for s, j in near]


def test_small_groups_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    monkeypatch.setattr(V, "QUERIES", 64)
    v = spark.range(1000).select(F.col("id").alias("node"), F.when(F.col("id") < 200, F.lit(-1)).otherwise(F.col("id") % 40).alias("w"))
    q, met = V.met(v.withColumnRenamed("node", "q"), v)
    copies = {r.w: r.n for r in met.count().groupBy("w").agg(F.sum("count").alias("n")).collect()}
    assert copies.pop(-1) == 200 * 4 and set(copies.values()) == {20}  # of all in one, 16 blocks each
    assert q.count().agg(F.sum("count")).first()[0] == 200 * 4 + 800


def test_batches_of_groups_are_bounded_in_bytes(spark):
    from skein.operators import graph_index as GI

    key, (_, df) = "spark.sql.execution.arrow.maxBytesPerBatch", make(spark, 60)
    before = spark.conf.get(key, None)
    try:
        for now, want in (("268435456", GI.BATCH_BYTES), ("65536", 65536)):
            spark.conf.set(key, now)
            GI.neighbour_graph(df.limit(1))
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_neighbour_graphs_of_queries_have_as_many_blocks_as_their_vectors_need(spark, monkeypatch):
    from skein.operators import communities, hierarchy
    from skein.plans.more_queries import query

    asked, met = [], V.met
    monkeypatch.setattr(V, "met", lambda q, v, blocks=None: asked.append(blocks) or met(q, v, blocks))
    monkeypatch.setattr(communities, "communities_near", lambda w, *a: (w, 1.0))
    monkeypatch.setattr(hierarchy, "hierarchy", lambda v, *a, **b: v)
    for name in ("d29_communities", "e17_graph_hierarchy"):
        query.queries[name](spark, "/root/testdata/sf0.001")
    assert asked == [None, None]
