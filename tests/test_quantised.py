"""The saved index of product codes: size and recall."""

import glob
import os

import numpy as np
import pytest

from skein.operators import quantised as Q
from skein.operators.vectors import exact_neighbours


def test_recall_after_rerank_and_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "CODES", 300)
    monkeypatch.setattr(Q, "QUERIES", 40)
    r = np.random.default_rng(5)
    v = r.normal(size=(25, 64))[r.integers(0, 25, 4000)] + r.normal(size=(4000, 64)) * 0.7
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, v array<float>").cache()
    index = Q.CodeIndex(spark, str(tmp_path / "ix"))
    books = Q.fit_codebooks(df, 16, parts=16, entries=64, sample=2000)
    index.save(df, books)
    kept = sum(len(x.code) for x in spark.read.parquet(f"{tmp_path}/ix/codes").collect())
    assert kept * 10 <= v.nbytes and len(glob.glob(f"{tmp_path}/ix/codes/cell=*")) == 16
    assert np.allclose(index.books().books, books.books) and os.path.isdir(f"{tmp_path}/ix/books")
    queries = df.filter("node % 40 = 0")
    got = {(x.node, x.nbr): x.score for x in index.search(queries, df, 10, 8, 120).collect()}
    want = {(x.node, x.nbr): x.score for x in exact_neighbours(queries, df, 10).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want) and len(got) == len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got.keys() & want.keys())
    assert index.search(queries.limit(0), df, 10, 4).collect() == []
    with pytest.raises(ValueError):
        Q.fit_codebooks(df.limit(0), 4)
