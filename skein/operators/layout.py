"""Maps of vectors by their neighbours: edge weights from per-point bandwidths, attraction along edges and sampled repulsion in blocks, places of later vectors on a finished map."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.corpus import dense_id
from skein.operators.embedding import Frozen
from skein.sources.staging import staged

#: Nodes of a block; positions of all blocks that a block sees as what to keep away from; edges of a node that are followed one by one.
BLOCK, SEEN, DEGREE = 4096, 2048, 256
#: The curve 1 / (1 + A d ** (2 B)) for a least distance of 0.1 and a spread of 1.
A, B = 1.577, 0.895
_STEP = 4.0


def _bandwidths(d: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Weights exp(-(d - least) / s) of rows of distances, s such that a row's sum is the logarithm (to 2) of how many it has; by bisection."""
    least = np.where(there, d, np.inf).min(1, keepdims=True)
    away = np.where(there, d - least, np.inf)
    want = np.log2(np.maximum(there.sum(1, keepdims=True), 2))
    low, high = np.full_like(least, 1e-6), np.full_like(least, 1e3)
    for _ in range(48):
        s = np.sqrt(low * high)
        over = np.exp(-away / s).sum(1, keepdims=True) > want
        low, high = np.where(over, low, s), np.where(over, s, high)
    return np.exp(-away / np.sqrt(low * high))


def memberships(near: DataFrame) -> DataFrame:
    """a, b, w (0 to 1) of lists of nearest nodes (a, b, d): 1 for the nearest, and falling with distance as fast as the point's surroundings are dense."""
    lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct(F.round("d", 9).alias("d"), "b"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            size = np.diff(col.offsets.to_numpy().astype(np.int64))
            flat = col.flatten()
            there = np.arange(size.max(initial=0)) < size[:, None]
            d = np.zeros(there.shape)
            d[there] = flat.field("d").to_numpy()
            a = np.repeat(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(a), flat.field("b"), pa.array(_bandwidths(d, there)[there])], names=["a", "b", "w"])

    return lists.mapInArrow(run, "a bigint, b bigint, w double")


def fuzzy_edges(near: DataFrame) -> DataFrame:
    """a, b, w both ways: of the two memberships of a pair, p and q, p + q - p q."""
    m = memberships(near)
    both = m.select("a", "b", F.col("w").alias("p"), F.lit(0.0).alias("q")).union(m.select("b", "a", F.lit(0.0), "w"))
    return both.groupBy("a", "b").agg(F.max("p").alias("p"), F.max("q").alias("q")).select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w")).filter("w > 1e-4")


def _forces(x: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attraction of x to, and repulsion from, points that lie `away` from it, before weights."""
    d2 = (away * away).sum(-1, keepdims=True)
    curve = 1 + A * np.maximum(d2, 1e-12) ** B
    pull = -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / curve * away
    push = 2 * B / ((0.001 + d2) * curve) * away
    return np.clip(pull, -_STEP, _STEP), np.clip(push, -_STEP, _STEP)


def _sweeps(own: pd.DataFrame, edges: pd.DataFrame, seen: np.ndarray, sweeps: int, start: float, end: float, repel: float, seed: int) -> pd.DataFrame:
    """Positions of a block after sweeps in which its nodes move side by side; nodes of other blocks stay where they are."""
    own = own.sort_values("node").reset_index(drop=True)
    edges = edges.sort_values(["a", "b"])
    ids, x = own.node.to_numpy(), own[["x", "y"]].to_numpy(float)
    at = np.searchsorted(ids, edges.a.to_numpy())
    to = np.searchsorted(ids, edges.b.to_numpy()).clip(0, len(ids) - 1)
    inside = ids[to] == edges.b.to_numpy()
    fixed, w = edges[["bx", "by"]].to_numpy(float), edges.w.to_numpy(float)[:, None]
    degree = np.bincount(at, w[:, 0], len(ids))[:, None]
    rng = np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF])
    speed = np.zeros_like(x)
    for k in range(sweeps):
        alpha = start + (end - start) * k / sweeps
        there = np.where(inside[:, None], x[to], fixed)
        pull, _ = _forces(x[at], x[at] - there)
        force = np.stack([np.bincount(at, (w * pull)[:, i], len(ids)) for i in (0, 1)], 1)
        some = seen[rng.integers(0, len(seen), (len(ids), 24))]
        _, push = _forces(x, x[:, None] - some)
        force = (2 * force + repel * degree * push.mean(1)) / np.maximum(degree, 1)
        speed = 0.5 * speed + force
        x = x + alpha * np.clip(speed, -_STEP, _STEP)
    return pd.DataFrame({"node": ids, "x": x[:, 0], "y": x[:, 1]})


def _epoch(seen: np.ndarray, sweeps: int, start: float, end: float, repel: float, seed: int):
    """The function of a block's nodes (node, block, x, y) and their edges (a, b, w, bx, by) that moves the nodes."""
    def run(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return _sweeps(own, edges, seen, sweeps, start, end, repel, seed).assign(block=own.block.iloc[0])

    return run


def neighbour_map(near: DataFrame, first: DataFrame, epochs: int = 12, sweeps: int = 30, repel: float = 5.0, seed: int = 1) -> DataFrame:
    """node, x, y: a map on which nodes lie near their nearest ones (near: a, b, d), from first positions (node, x, y); scaled as Frozen does. Deterministic.

    Nodes are dealt to blocks of about BLOCK by their first position, so that most edges stay inside a block. In an epoch each block moves its nodes by `sweeps` steps against the others' last positions, of which it has
    those of its nodes' neighbours, and SEEN picked by hash to keep away from; then positions are exchanged. Of a node with more than DEGREE edges about as many are followed, picked by hash, each for its share of all.
    """
    n = first.count()
    if n < 3:
        return first.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    start = Frozen.fit(first).apply(first).select("node", F.round(F.col("x") / 10, 5).alias("x"), F.round(F.col("y") / 10, 5).alias("y"))  # rounded, as sums over partitions come in any order
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(1023), F.floor((F.col(c) + 10) * 51.2))).cast("bigint")
    bits = [F.shiftleft(F.shiftright(cell(c), i).bitwiseAND(F.lit(1)), 2 * i + k) for i in range(10) for k, c in enumerate("xy")]
    curve = functools.reduce(lambda p, q: p.bitwiseOR(q), bits)  # places that are near on it are near on the map
    ranked = dense_id(start.withColumn("curve", curve), ["curve", "node"], "at")
    placed = staged(ranked.select("node", F.floor(F.col("at") / BLOCK).cast("int").alias("block"), "x", "y"), "map-positions")
    w = staged(fuzzy_edges(near), "map-edges")
    many = w.groupBy("a").agg(F.count("*").alias("deg"))
    share = F.greatest(F.lit(1.0), F.col("deg") / DEGREE)
    kept = w.join(many, "a").filter(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)) * share < F.lit(1 << 30)).select("a", "b", (F.col("w") * share).alias("w"))
    edges = staged(kept.join(placed.select(F.col("node").alias("a"), "block"), "a"), "map-edges")
    for e in range(epochs):
        pick = placed if n <= SEEN else placed.filter(F.pmod(F.xxhash64("node", F.lit(e)), F.lit(1 << 30)) * n < F.lit(SEEN << 30))
        seen = np.array([(r.x, r.y) for r in pick.orderBy("node").limit(2 * SEEN).select("x", "y").collect()])
        run = _epoch(seen, sweeps, 0.4 * (1 - e / epochs) + 0.01, 0.4 * (1 - (e + 1) / epochs) + 0.01, repel, seed * 1000 + e)
        there = edges.join(placed.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")
        moved = placed.groupBy("block").cogroup(there.groupBy("block")).applyInPandas(run, "node bigint, x double, y double, block int")
        placed = staged(moved.select("node", "block", "x", "y"), "map-positions", replaces=placed)
    at = placed.select("node", "x", "y")
    return Frozen.fit(at).apply(at)


def place(near: DataFrame, on: DataFrame) -> DataFrame:
    """node, x, y for new nodes from their nearest ones on a finished map (near: a new, b old, d): the mean of those places, by membership. The map (node, x, y) stays as it is."""
    m = memberships(near).join(on.select(F.col("node").alias("b"), "x", "y"), "b")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    return m.groupBy(F.col("a").alias("node")).agg(mean("x"), mean("y"))
