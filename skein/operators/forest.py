"""Least spanning forests, and the order in which they merge, by rounds of joins.

In a round every component takes the least edge that leaves it (Borůvka); components that are so joined are contracted. The rounds also give the single-linkage tree without a sequential pass: an edge taken in round l
hangs the component that took it, as one branch, onto a chain of heavier edges, and which chain that is follows from comparing the edge with what its component takes in later rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.staging import TASK_ROWS, observed, staged

#: Edges are ordered by weight, then by their ends, so that no two are alike.
ORDER = ("w", "a", "b")
#: More edges (a, b, w, ca, cb) that the least ones of a round may have missed, from the nodes' components (node, what else is known of it, c) and what these would take.
More = Callable[[DataFrame, DataFrame], "DataFrame | None"]


def least_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the least spanning forest of edges a < b by ORDER; of equal edges the first."""
    order = np.lexsort((b, a, w))
    ends = np.unique(np.stack([a, b])[:, order], return_inverse=True)[1].reshape(2, -1)
    n = int(ends.max(initial=-1)) + 1
    kept, at = [], np.arange(len(order))  # edges by rank, those inside a component left out
    while len(at):
        least = np.full(n, len(order))
        np.minimum.at(least, ends.ravel(), np.tile(np.arange(len(at)), 2))
        has = np.flatnonzero(least < len(order))
        edge, to = least[has], np.arange(n)
        to[has] = ends[0, edge] + ends[1, edge] - has
        twice = (to[to] == np.arange(n)) & (np.arange(n) < to)  # two that take one edge
        to[twice] = np.flatnonzero(twice)
        kept.append(at[np.unique(edge)])
        while not np.array_equal(up := to[to], to):
            to = up
        ends = to[ends]
        apart = ends[0] != ends[1]
        ends, at = ends[:, apart], at[apart]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def thinned(edges: DataFrame, rows: int, *place: str) -> DataFrame:
    """a, b, w: edges (a, b, w, and the columns `place`), so many rows, without some that are the heaviest of a circle, as the least spanning forest has none of these. Ranges of places, about TASK_ROWS / 2 edges each, keep their own least forests: where
    near edges have near places, little more than one edge a node stays."""
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", *place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b.select(["a", "b", "w"]) for b in batches] or [pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})])
        yield from t.take(pa.array(least_forest(*(t[c].to_numpy() for c in "abw")))).to_batches()

    dealt = e.repartitionByRange(max(1, -(-2 * rows // TASK_ROWS)), *place, "a", "b").select(*[F.col(c).cast("bigint").alias(c) for c in "ab"], F.col("w").cast("double").alias("w"))
    return dealt.mapInArrow(run, "a bigint, b bigint, w double")


def _taken(edges: DataFrame) -> DataFrame:
    """c, w, a, b, to: the least edge that leaves each component."""
    both = edges.select(F.col("ca").alias("c"), *ORDER, F.col("cb").alias("to")).union(edges.select("cb", *ORDER, "ca"))
    return both.groupBy("c").agg(F.min(F.struct(*ORDER, "to")).alias("p")).select("c", "p.*")


def _roots(taken: DataFrame) -> DataFrame:
    """c, up: the component that each one becomes part of, named after one that belongs to it."""
    other = taken.select(F.col("c").alias("to"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    mutual = (F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob"))  # two take the same edge in each joined group, and only two
    up = staged(taken.join(other, "to").select("c", F.when(mutual & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")), "forest-up")
    while True:
        far = up.select(F.col("c").alias("up"), F.col("up").alias("far"))
        now = up.join(far, "up").select("c", "far", (F.col("far") != F.col("up")).alias("moved")).withColumnRenamed("far", "up")
        now, seen = observed(now, "forest-up", moved=F.count_if("moved"))
        if not seen["moved"]:
            return now.select("c", "up")
        up = now.select("c", "up")


class Rounds:
    """taken[l]: c, w, a, b, to of round l. ups[l]: c, up from the components of round l to those of the next. nodes: node."""

    def __init__(self, nodes: DataFrame, taken: list[DataFrame], ups: list[DataFrame]):
        self.nodes, self.taken, self.ups = nodes, taken, ups

    def edges(self) -> DataFrame | None:
        """a, b, w of the forest."""
        out = None
        for t in self.taken:
            one = t.select("a", "b", "w").distinct()
            out = one if out is None else out.unionByName(one)
        return out


def spanning_rounds(nodes: DataFrame, edges: DataFrame, more: More | None = None) -> Rounds:
    """The rounds of contraction of nodes (node, and with `more` what it wants to know of them) along undirected edges (a, b, w): as many as the logarithm of the nodes at most."""
    known = nodes
    nodes = staged(nodes.select("node").distinct(), "forest-nodes")
    e = edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    e = staged(e.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-edges")
    label = known.withColumn("c", F.col("node"))
    taken, ups = [], []
    while True:
        now, seen = observed(_taken(e), "forest-taken", n=F.count("*"))
        extra = more(label, now) if more else None
        if extra is not None:
            e = e.unionByName(extra)
            now, seen = observed(_taken(e), "forest-taken", n=F.count("*"))
        if not seen["n"]:
            return Rounds(nodes, taken, ups)
        up = _roots(now)
        taken.append(now)
        ups.append(up)
        side = lambda x: up.select(F.col("c").alias(f"c{x}"), F.col("up").alias(f"n{x}"))  # noqa: B023, E731
        kept = e.join(side("a"), "ca").join(side("b"), "cb").filter("na <> nb")
        least = kept.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).agg(F.min(F.struct(*ORDER)).alias("p"))
        e = staged(least.select("p.a", "p.b", "p.w", "ca", "cb"), "forest-edges")
        if more:
            label = staged(label.join(up, "c", "left").select(*known.columns, F.coalesce("up", "c").alias("c")), "forest-labels", replaces=label)


def chains(rounds: Rounds) -> DataFrame:
    """The single-linkage tree as chains: level, v, round, w, a, b, hang, low, takers.

    Every edge of the forest is one row, a merge; round is the one in which it was taken. The merges of a chain (level, v), in order, each add `hang` nodes to what the ones before it hold; the first of them joins the two branches of
    its `takers` (low: nodes of the smaller), any other one the branch of the one component that took it. A branch is a node in round 0, else the chain (round, component), and ends below the edge
    that the component took.
    """
    size = rounds.nodes.select(F.col("node").alias("c"), F.lit(1).cast("bigint").alias("s"))
    open_, out, last = None, None, len(rounds.taken)
    for j in range(1, last + 1):
        new = rounds.taken[j - 1].join(size, "c").join(rounds.ups[j - 1], "c").groupBy(*ORDER).agg(F.sum("s").alias("hang"), F.min("s").alias("low"), F.count("*").alias("takers"), F.min("up").alias("v")).withColumn("round", F.lit(j - 1))
        here = new if open_ is None else open_.unionByName(new)
        if j < last:
            nxt = rounds.taken[j].select(F.col("c").alias("v"), F.struct(*ORDER).alias("next")).join(rounds.ups[j].withColumnRenamed("c", "v"), "v")
            here = staged(here.join(nxt, "v", "left").withColumn("closed", F.col("next").isNull() | (F.struct(*ORDER) < F.col("next"))).drop("next"), "chains")
        else:
            here = staged(here.withColumn("closed", F.lit(True)).withColumn("up", F.col("v")), "chains")
        closed = here.filter("closed").select(F.lit(j).alias("level"), "v", "round", *ORDER, "hang", "low", "takers")
        out = closed if out is None else out.unionByName(closed)
        size = closed.groupBy(F.col("v").alias("c")).agg(F.sum("hang").alias("s"))
        open_ = here.filter("not closed").select(*ORDER, "hang", "low", "takers", F.col("up").alias("v"), "round")
    if out is None:
        none = rounds.nodes.limit(0)
        return none.select(F.lit(0).alias("level"), F.col("node").alias("v"), F.lit(0).alias("round"), F.lit(0.0).alias("w"), F.col("node").alias("a"), F.col("node").alias("b"), *[F.lit(0).cast("bigint").alias(c) for c in ("hang", "low", "takers")])
    return out


def scanned(chain: DataFrame, least: int) -> DataFrame:
    """chain with size (nodes below each merge), split (both branches have `least` nodes or more) and above (the next split of the chain beyond it, or null).

    A chain may hold most of the merges, so chains are cut by ranges of their order, and what a range adds is passed on from range to range.
    """
    at = [*(F.col(c) for c in ("level", "v", *ORDER))]
    parts = staged(chain.repartitionByRange(*at).withColumn("part", F.spark_partition_id()), "chain-parts")
    inside = Window.partitionBy("part", "level", "v").orderBy(*ORDER)
    runs = parts.groupBy("part", "level", "v").agg(F.sum("hang").alias("run"))
    before = runs.withColumn("before", F.coalesce(F.sum("run").over(Window.partitionBy("level", "v").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("run")
    sized = parts.join(before, ["part", "level", "v"]).withColumn("size", F.sum("hang").over(inside) + F.col("before")).drop("before")
    split = F.when(F.col("takers") == 2, F.col("low") >= least).otherwise((F.col("hang") >= least) & (F.col("size") - F.col("hang") >= least))
    sized = staged(sized.withColumn("split", split), "chain-sizes")
    edge = F.struct(*ORDER)
    firsts = sized.groupBy("part", "level", "v").agg(F.min(F.when(F.col("split"), edge)).alias("first"))
    # What follows is looked at from the end on: a frame up to the last row is evaluated anew for each row, one from the first row goes on from row to row.
    beyond = firsts.withColumn("beyond", F.min("first").over(Window.partitionBy("level", "v").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))).drop("first")
    from_end = Window.partitionBy("part", "level", "v").orderBy(*map(F.desc, ORDER))
    local = F.min(F.when(F.col("split"), edge)).over(from_end.rowsBetween(Window.unboundedPreceding, -1))
    return staged(sized.withColumn("local", local).join(beyond, ["part", "level", "v"]).withColumn("above", F.coalesce("local", "beyond")).drop("local", "beyond", "part"), "chain-scanned")
