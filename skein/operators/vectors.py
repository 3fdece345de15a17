"""Vector search and clustering on array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from skein.functions.vectors import unit
from skein.sources.staging import staged

#: Vectors and queries of a block; queries of it that are compared at a time.
BLOCK, QUERIES, AT_ONCE = 8192, 8192, 256
#: Queries that a task holds while all vectors pass by, and tasks to make of fewer.
HELD, TASKS = 32_768, 16


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a column of number lists of one length, in double precision."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _best_of_block(k: int, digits: int):
    """The function of a block of queries (q, qv) and one of vectors (node, v) that gives each query's k best: node, nbr, score."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, n = queries["q"].combine_chunks(), vectors["node"].combine_chunks()
        qs, ns = q.to_numpy(), n.to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(qs) and len(ns):
            x, y = matrix(queries["qv"].combine_chunks()), matrix(vectors["v"].combine_chunks()).T
            for lo in range(0, len(qs), AT_ONCE):
                s = x[lo : lo + AT_ONCE] @ y
                s[qs[lo : lo + AT_ONCE, None] == ns[None]] = -np.inf
                least = np.partition(s, len(ns) - min(k, len(ns)), axis=1)[:, len(ns) - min(k, len(ns))]
                i, j = np.nonzero((s >= least[:, None] - 10.0**-digits) & (s > -np.inf))  # those that rounding may make equal to the last one
                score = np.round(s[i, j], digits)
                order = np.lexsort((ns[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((i[first] + lo, j[first], score[first]))
        i, j, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([q.take(pa.array(i)), n.take(pa.array(j)), pa.array(score)], names=["node", "nbr", "score"])

    return run


def met(queries: DataFrame, vectors: DataFrame, blocks: int | None = None) -> tuple[GroupedData, GroupedData]:
    """Queries (q, w, ...) and vectors (node, w, ...), grouped so that every query meets every vector of its group w in one pair of blocks; a null w meets nothing.

    Each group is cut by its own numbers of queries and vectors, so a small one is copied to few blocks, however many rows there are in all.
    """
    cut = lambda d, most, name: d.filter("w is not null").groupBy("w").agg(F.ceil(F.count("*") / most).alias(name))
    vb = cut(vectors, BLOCK, "vb") if blocks is None else cut(vectors, BLOCK, "vb").withColumn("vb", F.lit(blocks))
    many = staged(vb.join(cut(queries, QUERIES, "qb"), "w"), "block-counts")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    q = queries.join(many, "w").withColumn("i", deal("q", "qb")).withColumn("j", each("vb")).drop("qb", "vb")
    v = vectors.join(many, "w").withColumn("i", each("qb")).withColumn("j", deal("node", "vb")).drop("qb", "vb")
    return q.groupBy("w", "i", "j"), v.groupBy("w", "i", "j")


def exact_neighbours(queries: DataFrame, vectors: DataFrame, k: int, blocks: int | None = None, digits: int = 5, within: str | None = None) -> DataFrame:
    """node, nbr, score, rank: the k nearest vectors (node, v) of each query (node, v) by dot product (so many digits), itself left out, then least id; among vectors with the query's value of the column `within` alone, if one is given (null meets nothing).

    Queries and vectors meet block by block, matrix products of AT_ONCE queries each: every one of `blocks` blocks of a group's vectors (one for every BLOCK) keeps its k best of a query before anything is merged, so a query's merge has blocks * k rows.
    """
    group = F.lit(0) if within is None else F.col(within)
    kinds = dict(queries.dtypes)["node"], dict(vectors.dtypes)["node"]
    q, v = met(queries.select(F.col("node").alias("q"), F.col("v").alias("qv"), group.alias("w")), vectors.select("node", "v", group.alias("w")), blocks)
    near = q.cogroup(v).applyInArrow(_best_of_block(k, digits), f"node {kinds[0]}, nbr {kinds[1]}, score double")
    near = near.select("node", "nbr", F.round("score", digits).alias("score"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "nbr"))).filter(F.col("rank") <= k)


def _best_in_passing(k: int, digits: int):
    """The function of rows (part, kind, node, v), sorted by part and kind, that gives the k best vectors (kind 1) of each query (kind 0) of a part: node, nbr, score. Vectors go by a batch at a time; what is held is the queries and their best."""
    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for b in batches:
            part, kind, node, v = b["part"].to_numpy(), b["kind"].to_numpy(), b["node"].to_numpy(), matrix(b["v"])
            cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), True]) if len(part) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(part[lo]), int(kind[lo]), node[lo:hi], v[lo:hi]

    def merged(best: tuple, qs: np.ndarray, x: np.ndarray, ns: np.ndarray, y: np.ndarray) -> tuple:
        """best: (row, node, score) of the k best till now by row, and each row's worst of k (-inf if there are less)."""
        row, nbr, score, worst = best
        s = x @ y
        low = worst
        if np.isneginf(worst).any():  # one more than k, as the query itself may be among them
            place = max(len(ns) - k - 1, 0)
            low = np.where(np.isneginf(worst), np.partition(s, place, axis=1)[:, place], worst)
        i, j = np.nonzero(s >= low[:, None] - 10.0**-digits)  # those that rounding may make equal to the last one
        other = qs[i] != ns[j]
        i, j = i[other], j[other]
        row, nbr, score = np.r_[row, i], np.r_[nbr, ns[j]], np.r_[score, np.round(s[i, j], digits)]
        order = np.lexsort((nbr, -score, row))
        row, nbr, score = row[order], nbr[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, nbr, score = row[first], nbr[first], score[first]
        worst = np.full(len(qs), -np.inf)
        full = np.bincount(row, minlength=len(qs)) == k
        worst[full] = score[np.searchsorted(row, np.flatnonzero(full), side="right") - 1]
        return row, nbr, score, worst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, qs, x, best, waiting, held = None, [], [], [], [], 0

        def pass_by() -> None:
            nonlocal qs, x, waiting, held
            if isinstance(qs, list):
                qs, x = (np.concatenate(qs), np.concatenate(x)) if qs else (np.zeros(0, np.int64), np.zeros((0, 0)))
                best.extend((np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.full(len(qs[lo : lo + AT_ONCE]), -np.inf)) for lo in range(0, len(qs), AT_ONCE))
            if waiting and len(qs):
                ns, y = np.concatenate([n for n, _ in waiting]), np.concatenate([v for _, v in waiting]).T
                for c, lo in enumerate(range(0, len(qs), AT_ONCE)):
                    best[c] = merged(best[c], qs[lo : lo + AT_ONCE], x[lo : lo + AT_ONCE], ns, y)
            waiting, held = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            pass_by()
            for c, (row, nbr, score, _) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(qs[c * AT_ONCE + row]), pa.array(nbr), pa.array(score)], names=["node", "nbr", "score"])

        for part, kind, node, v in batches_of(batches):
            if part != now:
                yield from given()
                now, qs, x, best, waiting, held = part, [], [], [], [], 0
            if kind == 0:
                qs.append(node)
                x.append(v)
            else:
                waiting.append((node, v))
                held += len(node)
                if held >= BLOCK:
                    pass_by()
        yield from given()

    return run


def passing_neighbours(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """node, nbr, score, rank as of exact_neighbours, where queries are as many as the vectors: the vectors pass by up to HELD queries of a task, and only the best of all of them leave it, so that what is shuffled is
    a vector once for every HELD queries, and no list of a block. Where queries are few, vectors are cut into parts too, as many as make TASKS tasks."""
    kinds = dict(queries.dtypes)["node"], dict(vectors.dtypes)["node"]
    types = {dict(queries.dtypes)["v"], dict(vectors.dtypes)["v"]}
    kept = types.pop() if len(types) == 1 else "array<double>"
    many, most = queries.count(), vectors.count()
    cut = max(-(-many // HELD), min(TASKS, -(-many // AT_ONCE)), 1)
    parts = max(1, min(-(-TASKS // cut), -(-most // BLOCK)))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda d, kind, i, j: d.select(F.col("node").cast("bigint").alias("node"), F.col("v").cast(kept).alias("v"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    q = side(queries, 0, deal(cut), F.lit(0)).withColumn("j", each(parts))
    v = side(vectors, 1, F.lit(0), deal(parts)).withColumn("i", each(cut))
    rows = q.unionByName(v).select((F.col("i") * parts + F.col("j")).alias("part"), "kind", "node", "v")
    near = rows.repartitionById(cut * parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(_best_in_passing(k, digits), "node bigint, nbr bigint, score double")
    near = near.select(F.col("node").cast(kinds[0]).alias("node"), F.col("nbr").cast(kinds[1]).alias("nbr"), F.round("score", digits).alias("score"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "nbr"))).filter(F.col("rank") <= k)


def fit_cells(vectors: DataFrame, cells: int, sample: int = 50_000, rounds: int = 8) -> list[list[float]]:
    """Centroids of a coarse quantiser, by k-means on a sample of at most so many vectors; deterministic."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    some = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    model = KMeans(k=cells, seed=1, maxIter=rounds, featuresCol="f").fit(some.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f")))
    return [list(map(float, c)) for c in model.clusterCenters()]


def _cells(v: Column, centroids: list[list[float]]) -> Column:
    """Cells from the nearest to the farthest of a vector. The centroids go to the executors beside the plan, not in it."""
    c = np.array(centroids, np.float64)

    @F.pandas_udf("array<int>")
    def order(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        d = (c * c).sum(1)[None] / 2 - m @ c.T if len(x) else np.zeros((0, len(c)))
        return pd.Series(list(np.argsort(d, axis=1, kind="stable").astype(np.int32)), dtype=object)

    return order(v)


def approximate_neighbours(queries: DataFrame, vectors: DataFrame, centroids: list[list[float]], k: int, probes: int) -> DataFrame:
    """As exact_neighbours, but a query meets the vectors of its `probes` nearest cells alone. Every vector is in the index."""
    v = vectors.select("node", "v", _cells(F.col("v"), centroids)[0].alias("cell"))
    q = queries.select("node", "v", F.explode(F.slice(_cells(F.col("v"), centroids), 1, probes)).alias("cell"))
    return exact_neighbours(q, v, k, within="cell")


def probes_needed(queries: DataFrame, vectors: DataFrame, centroids: list[list[float]], k: int, recall: float) -> int:
    """The least number of probes with which some queries, found by exact search, have this recall."""
    true = exact_neighbours(queries, vectors, k).join(queries.select("node", _cells(F.col("v"), centroids).alias("order")), "node")
    at = true.join(vectors.select(F.col("node").alias("nbr"), _cells(F.col("v"), centroids)[0].alias("cell")), "nbr").select(F.array_position("order", F.col("cell")).alias("p"))
    counts = {r.p: r["count"] for r in at.groupBy("p").count().collect()}  # a row a cell
    seen, total = 0, sum(counts.values())
    for p in range(1, len(centroids) + 1):
        seen += counts.get(p, 0)
        if seen >= recall * total:
            return p
    return len(centroids)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """by, c: unit mean of each group's vectors, added place by place."""
    each = vectors.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a")).select(by, unit(F.transform("a", lambda x: x["s"])).alias("c"))


def quadtree(points: DataFrame, depth: int, least: int = 3) -> DataFrame:
    """points: node, x, y. band, ix, iy, n, cx, cy, parent_ix, parent_iy of the cells with `least` points or more at 2 ** (2 + band) cells a side."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = points.crossJoin(F.broadcast(box)).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))  # one row
    side = 4 * F.pow(F.lit(2.0), F.col("band"))
    at = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * side), side.cast("bigint") - 1))
    cells = p.groupBy("band", at("x", "x0", "x1").alias("ix"), at("y", "y0", "y1").alias("iy")).agg(F.count("*").alias("n"), F.round(F.avg("x") + 1e-7, 4).alias("cx"), F.round(F.avg("y") + 1e-7, 4).alias("cy"))
    up = lambda c: F.when(F.col("band") > 0, F.floor(F.col(c) / 2)).otherwise(-1)
    return cells.filter(F.col("n") >= least).withColumn("parent_ix", up("ix")).withColumn("parent_iy", up("iy"))
