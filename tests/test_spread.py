"""Large tables of two numbers a row are dealt by rows, not by bytes."""

from skein.plans import tables as T
from skein.sources import staging
from tests.test_blocks import plan


def test_distinct_pairs_hold_about_as_many_rows_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "TASK_ROWS", 500, raising=False)
    rows = [(k % 700, k % 90 + 1, k % 13) for k in range(6000)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for df, want in ((T.edges(spark, str(tmp_path)), {(a, b) for a, b, _ in rows if a != b}), (T.authorship(spark, str(tmp_path)), {(a, c) for a, _, c in rows})):
        got = [tuple(r) for r in df.collect()]
        assert set(got) == want and len(got) == len(want)
        assert df.rdd.getNumPartitions() == 12


def test_papers_by_name_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    from skein.plans import view_queries as VQ

    monkeypatch.setattr(staging, "TASK_ROWS", 100, raising=False)
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    make("lineitem", [(1, 1, 1), (2, 1, 1), (3, 1, 2)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint")
    make("nation", [(0, 7), (1, 8)], "n_nationkey int, n_regionkey int")
    make("supplier", [(1, 0), (2, 1)], "s_suppkey bigint, s_nationkey int")
    make("customer", [(1, 0), (2, 1)], "c_custkey bigint, c_nationkey int")
    make("orders", [(k, 1 + (k > 900)) for k in range(1, 1001)], "o_orderkey bigint, o_custkey bigint")
    df = VQ.query.queries["f3_f4_org_rollup"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(7, 900, 2), (8, 101, 1)]
    assert "REPARTITION_BY_NUM" in plan(df)


def test_labels_of_papers_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    from skein.plans import more_queries as MQ

    monkeypatch.setattr(staging, "TASK_ROWS", 100, raising=False)
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    make("lineitem", [(k, 1, 1 + k % 3) for k in range(300)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint")
    make("supplier", [(k, k, f"S{k}") for k in (1, 2, 3)], "s_suppkey bigint, s_nationkey int, s_name string")
    df = MQ.query.queries["m3_node_labels"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted((k, f"{x}{1 + k % 3}") for k in range(300) for x in "SN")
    assert df.rdd.getNumPartitions() == 6  # rows of both kinds / TASK_ROWS


def test_citations_are_counted_by_bounded_tasks(spark, monkeypatch):
    from skein.operators import graph as G

    monkeypatch.setattr(staging, "TASK_ROWS", 100, raising=False)
    raw = [(k % 50, k * k % 41) for k in range(1000)]
    known = set(range(0, 60, 2))
    df = G.citation_totals(spark.createDataFrame(raw, "src bigint, dst bigint").coalesce(1), spark.createDataFrame([(k,) for k in known], "node bigint"))
    want = {k: (sum(b == k for _, b in raw), sum(a == k for a, _ in raw), len({a for a, b in raw if b == k and a != k and a in known})) for k in known}
    assert {r.node: (r.incoming, r.outgoing, r.internal) for r in df.collect()} == want
    assert plan(df).count("REPARTITION_BY_NUM") >= 3
