import math

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import embedding as E
from skein.operators import vectors as V


def test_hashed_vectors_and_coverage(spark):
    texts = spark.createDataFrame([(k, f"graph theory of topic {k % 3} number {k}") for k in range(30)] + [(99, None)], "node long, text string")
    v = {r.node: r.v for r in E.hashed_vectors(texts, 64).collect()}
    assert len(v) == 31 and all(abs(math.fsum(x * x for x in v[k]) - 1) < 1e-9 for k in range(30)) and not any(v[99])
    given = spark.createDataFrame([(k, [1.0] * 64) for k in range(10)], "node long, v array<double>")
    count = lambda p: E.with_coverage(texts.select("node"), given, texts, p, 0.5, 64).count()
    assert (count("drop"), count("fill"), count("auto")) == (10, 31, 31)


def test_projection_is_scaled_and_kept(spark):
    pts = spark.createDataFrame([(k, float(k), float(k % 7)) for k in range(200)], "node long, x double, y double")
    f = E.Frozen.fit(pts)
    out = f.apply(pts).agg(F.avg("x").alias("x"), F.max("x").alias("m")).first()
    assert abs(out.x) < 1e-9 and 95 < out.m < 110
    assert f.apply(spark.createDataFrame([(1, f.cx, f.cy)], "node long, x double, y double")).first()[1:] == (0.0, 0.0)
    with pytest.raises(ValueError):
        E.Frozen.fit(spark.createDataFrame([(1, float("nan"), 0.0)], "node long, x double, y double"))
    vec = pts.select("node", F.array("x", "y", F.col("x") * 2).alias("v"))
    assert E.project(vec).count() == 200
    assert E.clusters(vec, 4).select("cluster").distinct().count() == 4


def test_saved_index(spark, tmp_path):
    vec = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(300)], "node long, v array<double>")
    c = V.fit_cells(vec, 6)
    E.save_index(vec, c, str(tmp_path / "ix"))
    got = [r.node for r in E.search_index(spark, str(tmp_path / "ix"), c, [1.0, 0.0], 5, 3).collect()]
    want = sorted(range(300), key=lambda k: (-round(math.cos(k), 4), k))[:5]
    assert got == want
    assert 1 <= V.probes_needed(vec.filter("node < 40"), vec, c, 5, 0.9) <= 6


def test_captions(spark):
    rows = [("Figure 1: A map",), ("Fig. 1 A map",), ("Table 1 reports our results",), ("Table 1. Data",), ("Figure 10: no",), ("Figure 1.1: GPT",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(T.first_caption(F.col("s"))).collect()]
    assert got == [True, True, False, True, False, True]
