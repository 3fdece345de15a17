"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import decimal
import glob
import importlib
import os

import duckdb
import pytest

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
MODULES = ("corpus_queries", "graph_queries", "view_queries", "more_queries", "neighbour_queries", "flagship")
REGISTRIES = [importlib.import_module(f"skein.plans.{m}").query for m in MODULES]
SQL = {k: v for r in REGISTRIES for k, v in r.sql.items()}
QUERIES = {k: v for r in REGISTRIES for k, v in r.queries.items()}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df, want = QUERIES[name](spark, DIR), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
