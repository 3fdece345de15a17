"""Queries held against plain Python statements of their rules."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def run(spark, name, d=DIR):
    return entry.queries()[name](spark, d).collect()


def sql(text, d=DIR):
    c = duckdb.connect()
    for t in ("customer", "embeddings", "part", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c.sql(text).fetchall()


def neighbours(d=DIR):
    """References and citers of each node."""
    refs, citers = defaultdict(set), defaultdict(set)
    for s, t in sql("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey <> l_partkey", d):
        refs[s].add(t)
        citers[t].add(s)
    return refs, citers


def jaccard(x, y):
    return len(x & y) / len(x | y) if x & y else 0.0


def score(refs, citers, a, b):
    return 1.0 if b in refs[a] or a in refs[b] else 0.5 * (jaccard(refs[a], refs[b]) + jaccard(citers[a], citers[b]))


@tables
def test_fused_neighbours_of_all_nodes(spark):
    refs, citers = neighbours()
    got = run(spark, "d5_d6_fused_neighbours")
    v = dict(sql("SELECT vec_id, embedding FROM embeddings"))
    assert {r.a for r in got if r["mode"] == "text"} == set(v) and any(r.a >= 500 for r in got if r["mode"] == "fused") == any(n >= 500 for n in v)
    for r in got[:: max(1, len(got) // 500)]:
        cos = min(1.0, max(0.0, sum(x * y for x, y in zip(v[r.a], v[r.b], strict=True))))
        assert abs(r.score - (0.6 * cos + 0.4 * score(refs, citers, r.a, r.b))) < 1e-4


def test_phrases_of_all_places_and_lengths(spark, tmp_path):
    late = " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(200))
    rows = [(1, f"{late} five words in a row", "x"), (2, f"other five words in a row {late[::-1]}", "x"), (3, "alone here", "y"), (4, "alone", "y"), (5, "a b", "z"), (6, "a b", "z")]
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.phrase, r.df) for r in run(spark, "i18_shared_phrase", str(tmp_path))}
    want = set()
    for source in "xyz":
        df = Counter()
        for _, t, s in rows:
            w = t.split()
            df.update({tuple(w[i : i + n]) for n in range(2, 7) for i in range(len(w) - n + 1)} if s == source else ())
        best = min(((-c, -len(p), " ".join(p)) for p, c in df.items() if c >= 2), default=None)
        if best:
            want.add((source, best[2], -best[0]))
    assert got == want and ("x", "five words in a row", 2) in got


@tables
def test_citation_scores_through_hubs(spark):
    refs, citers = neighbours()
    got = run(spark, "d2_d3_citation_score")
    direct = {(a, b) for a in refs for b in refs[a]}
    assert direct | {(b, a) for a, b in direct} <= {(r.a, r.b) for r in got}
    assert all(abs(r.score - score(refs, citers, r.a, r.b)) < 2e-6 for r in got)
    hubs = {n for n, c in citers.items() if len(c) > 37}
    assert any(refs[r.a] & refs[r.b] & hubs for r in got if 0 < r.score < 1)
