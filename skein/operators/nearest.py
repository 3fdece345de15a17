"""Nearest points on a map, however its points are spread: leaves of a k-d tree over a bounded sample, exact search inside them, and across their borders as far as is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.staging import staged

#: Places that the tree is made from, about, and places of a leaf; the tree has at most a sixteenth as many leaves as the sample has places.
SAMPLE, LEAF = 200_000, 1500


class Tree:
    """axis (-1 in a leaf), value, left, right of each node; a leaf is named by its node."""

    def __init__(self, places: np.ndarray, most: int):
        self.axis, self.value, self.left, self.right = [], [], [], []
        self._grow(places, most)
        self.axis, self.value, self.left, self.right = (np.array(x) for x in (self.axis, self.value, self.left, self.right))

    def _grow(self, p: np.ndarray, most: int) -> int:
        me = len(self.axis)
        for x, v in ((self.axis, -1), (self.value, 0.0), (self.left, -1), (self.right, -1)):
            x.append(v)
        if len(p) > most:
            axis = int(np.argmax(np.ptp(p, axis=0)))
            value = float(np.median(p[:, axis]))
            low = p[:, axis] < value
            if low.any() and not low.all():
                self.axis[me], self.value[me] = axis, value
                self.left[me] = self._grow(p[low], most)
                self.right[me] = self._grow(p[~low], most)
        return me

    def leaves(self, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves): every leaf that the square of half side r around each place meets."""
        row, node, out = np.arange(len(p)), np.zeros(len(p), np.int64), []
        while len(row):
            axis = self.axis[node]
            done = axis < 0
            out.append((row[done], node[done]))
            row, node, axis = row[~done], node[~done], axis[~done]
            x, v = p[row, axis], self.value[node]
            low, high = x - r[row] < v, x + r[row] >= v
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.left[node][low], self.right[node][high]])
        rows, leaves = zip(*out, strict=True) if out else ((np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
        return np.concatenate(rows), np.concatenate(leaves)


def _xy(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(t[c], float) for c in "xy"], 1)


def _search(q: np.ndarray, bound: np.ndarray, t: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, squared distance, id) of each query's k nearest ids of the places of t (x, y, ids) within its bound, then least id."""
    lists = t["ids"].combine_chunks()
    ids = lists.flatten().to_numpy()
    at = _xy(t)[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))]
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], at[order]
    for lo in range(0, len(q), 256):
        some = q[lo : lo + 256]
        d2 = (some[:, 0, None] - at[None, :, 0]) ** 2 + (some[:, 1, None] - at[None, :, 1]) ** 2
        d2 = np.where(d2 <= bound[lo : lo + 256, None], d2, np.inf)
        near = np.argsort(d2, axis=1, kind="stable")[:, :k] if len(ids) <= 4 * k else _first(d2, k)
        row, dist = np.repeat(np.arange(len(some)) + lo, near.shape[1]), np.take_along_axis(d2, near, 1).ravel()
        there = dist < np.inf
        yield row[there], dist[there], ids[near.ravel()[there]]


def _first(d2: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k least values, of equals the first ones."""
    floor = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d2), k), np.int64)
    for i, (row, least) in enumerate(zip(d2, floor, strict=True)):
        below = np.flatnonzero(row < least[0])
        out[i] = np.concatenate([below, np.flatnonzero(row == least[0])[: k - len(below)]])
    return np.take_along_axis(out, np.argsort(np.take_along_axis(d2, out, 1), axis=1, kind="stable"), 1)


def nearest_points(points: DataFrame, k: int) -> DataFrame:
    """a, b, d2, rank: the k nearest other points (node, x, y) of each point, then least id; fewer if there are fewer.

    Points at one place are one row with their k + 1 least ids, as no one needs more of them. Each leaf finds the nearest of its places among its own, which bounds how far others can lie; a place whose bound reaches into other leaves asks
    these once more. A leaf has as many places as another, about, on any map.
    """
    want = k + 1
    salted = points.select(F.col("node").cast("bigint").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    first = lambda *g: F.row_number().over(Window.partitionBy("x", "y", *g).orderBy("node"))
    part = salted.withColumn("s", F.pmod(F.hash("node"), F.lit(64))).withColumn("r", first("s")).filter(F.col("r") <= want).withColumn("r", first()).filter(F.col("r") <= want)
    places = staged(part.groupBy("x", "y").agg(F.array_sort(F.collect_list("node")).alias("ids")), "places")
    n = max(places.count(), 1)
    sample = places.select("x", "y") if n <= SAMPLE else places.filter(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) * n < F.lit(SAMPLE << 30)).select("x", "y")
    some = np.array([(r.x, r.y) for r in sample.limit(2 * SAMPLE).collect()], float).reshape(-1, 2)
    tree = Tree(some, max(16, LEAF * len(some) // n, 4 * want * len(some) // n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, leaf = tree.leaves(p := _xy(b), np.zeros(b.num_rows))
            at = np.empty(len(p), np.int64)
            at[rows] = leaf
            yield pa.RecordBatch.from_arrays([pa.array(at), b["x"], b["y"], b["ids"]], names=["leaf", "x", "y", "ids"])

    dealt = staged(places.mapInArrow(deal, "leaf bigint, x double, y double, ids array<bigint>"), "leaves")

    def rows_of(q: np.ndarray, found: Iterator) -> list[pa.Array]:
        row, d2, ids = (np.concatenate(x) for x in zip(*[(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), *found], strict=True))
        return [pa.array(q[row, 0]), pa.array(q[row, 1]), pa.array(d2), pa.array(ids)]

    def inside(t: pa.Table) -> pa.Table:
        q = _xy(t)
        return pa.table([pa.array(np.full(len((c := rows_of(q, _search(q, np.full(len(q), np.inf), t, want)))[0]), t["leaf"][0].as_py())), *c], names=["leaf", "x", "y", "d2", "b"])

    own = staged(dealt.groupBy("leaf").applyInArrow(inside, "leaf bigint, x double, y double, d2 double, b bigint"), "near-inside")
    bound = own.groupBy("leaf", "x", "y").agg(F.when(F.count("*") >= want, F.max("d2")).otherwise(F.lit(float("inf"))).alias("bound"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, leaf = tree.leaves(_xy(b), np.sqrt(b["bound"].to_numpy()) * (1 + 1e-12))
            other = leaf != b["leaf"].to_numpy()[rows]
            at = pa.array(rows[other])
            yield pa.RecordBatch.from_arrays([pa.array(leaf[other]), b["x"].take(at), b["y"].take(at), b["bound"].take(at)], names=["leaf", "x", "y", "bound"])

    def across(asked: pa.Table, t: pa.Table) -> pa.Table:
        q = _xy(asked)
        found = _search(q, asked["bound"].to_numpy(), t, want) if len(q) and len(t) else iter(())
        return pa.table(rows_of(q, found), names=["x", "y", "d2", "b"])

    asking = bound.mapInArrow(reach, "leaf bigint, x double, y double, bound double")
    far = asking.groupBy("leaf").cogroup(dealt.groupBy("leaf")).applyInArrow(across, "x double, y double, d2 double, b bigint")
    near = own.select("x", "y", "d2", "b").unionByName(far)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("d2", "b"))).filter(F.col("r") <= want)
    lists = best.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("d2", "b"))).alias("l"))
    others = F.slice(F.filter("l", lambda p: p["b"] != F.col("a")), 1, k)
    return salted.withColumnRenamed("node", "a").join(lists, ["x", "y"]).select("a", F.posexplode(others).alias("i", "p")).select("a", "p.b", "p.d2", (F.col("i") + 1).alias("rank"))
