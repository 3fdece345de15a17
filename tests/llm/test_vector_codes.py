import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import vector_codes as V
from skein.llm.queries import op11_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds without trees, in Python integers."""
    kept = [(d, [math.floor(4096 * float(np.float32(x))) for x in v], c) for d, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(d, v + [0] * (parts * width - len(v)), c) for d, v, c in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : p * width + width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, z, strict=True)) for z in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else z for g, z in zip(groups, books[p], strict=True)]
    out, by = [], {}
    for d, v, c in kept:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(e for _, e in near)
        by[c] = by.get(c, 0) + error
        out.append((d, "".join(f"{k:02x}" for k, _ in near), error, c))
    return sorted(((d, code, e, by[c]) for d, code, e, c in out), key=str), books


def make(n, dims=16, seed=2):
    r = random.Random(seed)
    spots = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    rows = [(k * 3, [round(c + r.gauss(0, 0.1), 2) for c in r.choice(spots)], r.choice([None, 0, 1, 2])) for k in range(n)]
    same = [(9000 + k, [0.25] * dims, 5) for k in range(n // 3)]
    odd = [(-5, None, 1), (-4, [None] + [0.0] * (dims - 1), 1), (-3, [float("nan")] * dims, 1), (-2, [float("inf")] * dims, None), (None, [0.5] * dims, None), (3, rows[1][1], 2), (3, [9.0] * dims, 2), (6, rows[2][1], rows[2][2])]
    return rows + same + odd


@pytest.mark.parametrize(("leaf", "block"), [(16, 1 << 17), (1, 500), (3, 16 * 40)])
def test_against_plain_statement(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(V, "LEAF", leaf)
    monkeypatch.setattr(V, "BLOCK_VALUES", block)
    rows = make(300)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "code", "error", "n", "ids", "_n")}).repartition(3)
    got, table = V.compress(df)
    want, books = plain(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want
    assert [[list(v) for v in table[table.part == p].sort_values("entry").v] for p in range(8)] == books
    sha = hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in V.digest(df).select("codebooks_sha256").distinct().collect()} == {sha}


def test_trees_assign_as_all_distances_do():
    r = np.random.default_rng(4)
    for n in (1, 2, 15, 16, 17, 33, 500):
        for spread in (2, 50, 4000):  # a small one gives many ties
            v, z = r.integers(-spread, spread, (n, 2, 3)), r.integers(-spread, spread, (9, 3))
            z[5] = z[2]
            t = V.Trees.unpacked(n, 2, 3, V.Trees.build(v).packed())
            for p in range(2):
                codes = np.full(n, -1)
                sums, counts = t.assign(p, z, codes)
                want = ((v[:, p, None] - z[None]) ** 2).sum(2).argmin(1)
                assert (codes == want[t.order[p]]).all()
                assert (counts == np.bincount(want, minlength=9)).all() and all((sums[k] == v[want == k, p].sum(0)).all() for k in range(9))


def test_few_short_and_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [0.5] * 8, None)], [(2, [1.0, -1.0], 3), (1, [0.1] * 11, 3), (4, [], 3)]):
        want = plain(rows)[0]
        got, _ = V.compress(spark.createDataFrame(rows, SCHEMA))
        assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=str) == (want or [])
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([], SCHEMA), entries=300)


def test_query_and_many_rows_of_one_label(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(k, r.normal(0, 0.1, 16).tolist(), 7 if k % 3 else k) for k in range(1500)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in op11_vector_codes(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)[0]
