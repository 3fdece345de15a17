"""Pivots of more edges than the reference's limit make candidates too: queries against their SQL on a small table with such a pivot."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

HUB, CITERS = 5000, 1100


def lineitem(spark, at):
    """CITERS orders that cite one part, and a few that share others."""
    rows = [(i, HUB) for i in range(1, CITERS + 1)] + [(i, 6000 + i % 7) for i in range(1, 40)] + [(7000, 8000 + i) for i in range(5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")


def oracle(name, at, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return sorted(c.sql(entry.oracle_sql()[name]).fetchall())


def test_candidates_through_a_hub(spark, tmp_path):
    lineitem(spark, tmp_path)
    got = sorted(map(tuple, entry.queries()["d4_citation_candidates"](spark, str(tmp_path)).collect()))
    assert got == oracle("d4_citation_candidates", tmp_path, "lineitem")
    assert sum(a == CITERS and b <= 10 and n == 1 for a, b, n in got) == 10


@pytest.fixture
def far_apart(spark, tmp_path):
    """Twenty vectors that cite the hub, far from each other, and seventy that nothing links, which are all nearer: no text list holds one of the twenty."""
    lineitem(spark, tmp_path)
    at = lambda k: [0.3] + [math.sqrt(0.91) * (i == k) for i in range(20)]
    rows = [(40 + k, at(k), 0) for k in range(20)] + [(20000 + k, [1.0] + [0.0] * 20, 0) for k in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def through_hub(rows):
    """The partners of the vectors that cite the hub, if all are such vectors with the same score."""
    assert {round(r.score, 6) for r in rows if r.a < 20000} == {round(0.6 * 0.09 + 0.4 * 0.5, 6)}
    return {a: [r.b for r in sorted(rows, key=lambda r: r["rank"]) if r.a == a] for a in range(40, 60)}


def test_fused_neighbours_through_a_hub(spark, far_apart):
    rows = entry.queries()["d5_d6_fused_neighbours"](spark, far_apart).collect()
    got = sorted((r["mode"], r.a, r.b, round(r.score, 5), r["rank"]) for r in rows)
    assert got == [(*x[:3], round(x[3], 5), x[4]) for x in oracle("d5_d6_fused_neighbours", far_apart, "lineitem", "embeddings")]
    assert through_hub([r for r in rows if r["mode"] == "fused"]) == {a: [b for b in range(40, 60) if b != a][:15] for a in range(40, 60)}


def test_fused_on_graph_through_a_hub(spark, far_apart):
    rows = entry.queries()["d5_fused_on_graph"](spark, far_apart).collect()
    assert through_hub(rows) == {a: [b for b in range(40, 60) if b != a][:15] for a in range(40, 60)}
