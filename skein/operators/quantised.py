"""A saved index of product codes: cells of a coarse quantiser, codes of what a vector differs from its cell's centre by, search by tables of distances, and exact scores of the best."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.vectors import matrix

#: Vectors that codebooks are fitted to, at most about; codes and queries that meet at a time.
SAMPLE, CODES, QUERIES = 20_000, 50_000, 512


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of rows, by rounds of assignment and means from rows picked at random; an empty one stays."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        to = _nearest(x, c)
        n = np.bincount(to, minlength=len(c))
        s = np.stack([np.bincount(to, x[:, i], len(c)) for i in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


@dataclass
class Codebooks:
    """cells: (cells, dim). books: (parts, entries, dim / parts), of what vectors differ from their cell's centre by."""

    cells: np.ndarray
    books: np.ndarray

    def coded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(v, self.cells)
        parts = (v - self.cells[cell]).reshape(len(v), len(self.books), -1)
        return cell, np.stack([_nearest(parts[:, p], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)


def fit_codebooks(vectors: DataFrame, cells: int, parts: int = 16, entries: int = 256, rounds: int = 10, sample: int = SAMPLE, seed: int = 1) -> Codebooks:
    """Codebooks from about `sample` vectors (node, v) at most, picked by hash, on the driver. The dimension must be a multiple of `parts`."""
    n = vectors.count()
    some = vectors.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * n < F.lit(sample << 30)).orderBy("node").limit(2 * sample).select("v").collect()
    v = np.array([r.v for r in some], np.float64)
    if v.ndim != 2 or v.shape[1] % parts:
        raise ValueError("vectors must be there, and their length a multiple of the parts")
    c = _lloyd(v, cells, rounds, seed)
    rest = (v - c[_nearest(v, c)]).reshape(len(v), parts, -1)
    k = min(entries, len(v))
    return Codebooks(c, np.stack([_lloyd(rest[:, p], k, rounds, seed + p) for p in range(parts)]))


class CodeIndex:
    """A folder: codes (node, code, in a folder for each cell), and the codebooks beside them. A code is a byte a part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, vectors: DataFrame, books: Codebooks) -> None:
        """Every vector (node, v) is coded where it lies; cells are then gathered, large ones in several files."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, code = books.coded(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["node", "cell", "code"])

        coded = vectors.select(F.col("node").cast("bigint").alias("node"), "v").mapInArrow(run, "node bigint, cell int, code binary")
        coded.repartition("cell", F.pmod(F.xxhash64("node"), F.lit(16))).write.partitionBy("cell").parquet(f"{self.path}/codes")
        text = json.dumps({"cells": books.cells.tolist(), "books": books.books.tolist()})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/books")

    def books(self) -> Codebooks:
        x = json.loads(self.spark.read.text(f"{self.path}/books").first().value)
        return Codebooks(np.array(x["cells"]), np.array(x["books"]))

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, probes: int, rerank: int = 100) -> DataFrame:
        """node, nbr, score, rank: about the k best vectors by dot product of each query (node, v), itself left out.

        A query meets the codes of its `probes` nearest cells, block by block: its dot products with all entries of a part are looked up by code and added up. The vectors (node, v) of the `rerank` best alone are
        read, and scored exactly.
        """
        b = self.books()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column(1))
                d = (b.cells * b.cells).sum(1)[None] - 2 * v @ b.cells.T
                cells = np.argsort(d, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(v)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(cells.ravel().astype(np.int32))], names=["q", "qv", "cell"])

        def meet(asked: pa.Table, codes: pa.Table) -> pa.Table:
            q, n = asked["q"].to_numpy(), codes["node"].to_numpy()
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(q) and len(n):
                c = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(n), -1)
                v = matrix(asked["qv"].combine_chunks())
                table = np.einsum("qpd,ped->qpe", v.reshape(len(v), len(b.books), -1), b.books)
                base = v @ b.cells[codes["cell"][0].as_py()]
                for i in range(len(q)):
                    s = base[i] + table[i][np.arange(c.shape[1])[None], c].sum(1)
                    s[n == q[i]] = -np.inf
                    best = np.argsort(-s, kind="stable")[:rerank]
                    best = best[s[best] > -np.inf]
                    out.append((np.full(len(best), q[i]), n[best], s[best]))
            q, n, s = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table([pa.array(q), pa.array(n), pa.array(s)], names=["q", "nbr", "s"])

        asked = queries.select(F.col("node").cast("bigint").alias("node"), F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(near, "q bigint, qv array<double>, cell int")
        codes = self.spark.read.schema("node bigint, code binary, cell int").parquet(f"{self.path}/codes")
        blocks = codes.groupBy("cell").agg(F.ceil(F.count("*") / CODES).cast("int").alias("parts"))
        many = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        sizes = blocks.join(many, "cell")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asked.join(sizes, "cell").select("q", "qv", "cell", F.pmod(F.xxhash64("q"), "groups").cast("int").alias("g"), each("parts").alias("p"))
        right = codes.join(sizes, "cell").select("node", "code", "cell", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("p"), each("groups").alias("g"))
        rough = left.groupBy("cell", "g", "p").cogroup(right.groupBy("cell", "g", "p")).applyInArrow(meet, "q bigint, nbr bigint, s double")
        best = rough.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "nbr"))).filter(F.col("r") <= rerank)
        return exact_scores(best.select("q", "nbr"), queries, vectors, k)


def exact_scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """node, nbr, score, rank of pairs (q, nbr), by the vectors of both: the k best of each q."""
    from skein.functions.vectors import dot

    full = pairs.join(queries.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q").join(vectors.select(F.col("node").alias("nbr"), "v"), "nbr")
    scored = full.select(F.col("q").alias("node"), "nbr", F.round(dot(F.col("qv"), F.col("v")), 5).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "nbr"))).filter(F.col("rank") <= k)
