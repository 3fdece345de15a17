"""Citation candidates whose lists of ends are counted in pieces, against all pairs, and without the pairs being staged."""

from collections import Counter

import numpy as np

from skein.operators import graph as G


def brute(es, limit, cap, among=None):
    by, pairs = {0: {}, 1: {}}, Counter()
    for s, d in es:
        by[0].setdefault(d, []).append(s)
        by[1].setdefault(s, []).append(d)
    for side in by.values():
        for ends in side.values():
            if not cap or len(ends) <= cap:
                pairs.update((a, b) for a in ends for b in ends if a != b)
    out = {(a, b): pairs[a, b] for s, d in es for a, b in ((s, d), (d, s))}
    for a in {x for x, _ in pairs}:
        out |= {(a, b): pairs[a, b] for b in sorted((b for x, b in pairs if x == a), key=lambda b: (-pairs[a, b], b))[:limit]}
    return {k: v for k, v in out.items() if among is None or k[0] in among}


def test_candidates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST", 7)
    monkeypatch.setattr(G, "COUNTED", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        r = np.random.default_rng(3)
        es = sorted({(int(s), int(d)) for s, d in zip(r.integers(0, 80, 500), np.minimum(r.integers(0, 60, 500), r.integers(0, 60, 500))) if s != d})
        for shift in (0, 1 << 40):
            e = spark.createDataFrame([(s + shift, d + shift) for s, d in es], "src long, dst long")
            for cap, among in ((0, None), (12, None), (12, {3, 5, 70})):
                some = None if among is None else spark.createDataFrame([(x + shift,) for x in among], "node long")
                got = {(x.a - shift, x.b - shift): x.overlap for x in G.citation_candidates(e, 4, cap, some).collect()}
                assert got == brute(es, 4, cap, among)
        e = spark.createDataFrame(es, "src long, dst long")
        want = {(x.a, x.b): round(x.score, 9) for x in G.citation_scores(e, G.shared_of(e, G.citation_candidates(e, 4, 12))).collect()}
        assert {(x.a, x.b): round(x.score, 9) for x in G.scored_candidates(e, 4, 12).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_are_not_staged(spark, monkeypatch):
    """A pivot of 200 ends has 40,000 pairs; what is written to the shared folder is of the size of the edges."""
    rows, real = [], G.staged
    monkeypatch.setattr(G, "staged", lambda df, name, **k: (out := real(df, name, **k), rows.append(out.count()))[0])
    e = spark.range(1, 201).selectExpr("id AS src", "0L AS dst")
    assert G.citation_candidates(e, 2, 1000).count() == 2 * 200 + 2 * 200
    assert sum(rows) < 2000
