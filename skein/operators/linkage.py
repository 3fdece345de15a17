"""Average-linkage trees of unit vectors, by rounds in which all pairs that are each other's nearest merge at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.vectors import unit
from skein.operators.communities import components
from skein.operators.corpus import dense_id
from skein.operators.vectors import exact_neighbours
from skein.sources.staging import staged


def merges(vectors: DataFrame, digits: int = 9) -> DataFrame:
    """a, b, height: the n - 1 merges of average linkage of vectors (node, v) by cosine distance; a cluster is named after its least node, and a < b.

    The mean distance of two clusters' members is one less the dot product of their mean vectors, so a cluster is its sum and its size, and no table of pairs is kept. Merging one pair brings no other cluster nearer to it than its nearer part
    was; so pairs that are each other's nearest merge in any order, here all in one round. Of equally near ones (to so many digits) the pair of the least names comes first.
    """
    now = staged(vectors.select(F.col("node").cast("bigint").alias("node"), unit(F.col("v")).alias("s"), F.lit(1).cast("bigint").alias("n")), "linkage")
    out = None
    while now.limit(2).count() > 1:
        mean = now.select("node", F.transform("s", lambda x: x / F.col("n")).alias("v"))
        near = exact_neighbours(mean, mean, 1, digits=digits).select("node", "nbr", "score")
        # A node's nearest of least id is its first choice; of equals, the pair of least names is anybody's, so one at least is mutual.
        near = staged(near, "linkage-near")
        back = near.select(F.col("node").alias("nbr"), F.col("nbr").alias("node"))
        pairs = staged(near.join(back, ["node", "nbr"]).filter("node < nbr").select(F.col("node").alias("a"), F.col("nbr").alias("b"), (1 - F.col("score")).alias("height")), "linkage-merges")
        out = pairs if out is None else out.unionByName(pairs)
        to = pairs.select(F.col("b").alias("node"), F.col("a").alias("to"))
        moved = now.join(to, "node", "left").select(F.coalesce("to", "node").alias("node"), "s", "n")
        size = moved.groupBy("node").agg(F.sum("n").alias("n"))
        each = moved.select("node", F.posexplode("s").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("x"))
        now = staged(each.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l")).join(size, "node").select("node", F.transform("l", lambda p: p["x"]).alias("s"), "n"), "linkage")
    none = vectors.limit(0).select(F.col("node").cast("bigint").alias("a"), F.col("node").cast("bigint").alias("b"), F.lit(0.0).alias("height"))
    return none if out is None else out


def coarsened(vectors: DataFrame, target: int) -> DataFrame:
    """node, cluster (its least node): vectors (node, v) in `target` clusters of average linkage, or one each if there are no more."""
    nodes = staged(vectors.select(F.col("node").cast("bigint").alias("node")), "linkage-nodes")
    tree = staged(merges(vectors), "linkage-tree")
    keep = nodes.count() - target
    low = dense_id(tree, ["height", "a", "b"], "at").filter(F.col("at") < keep)
    joined = components(low.select("a", "b")) if keep > 0 else nodes.limit(0).withColumn("comp", F.col("node"))
    return nodes.join(joined, "node", "left").select("node", F.coalesce("comp", "node").alias("cluster"))


def coarsen_groups(members: DataFrame, target: int) -> DataFrame:
    """node, group: groups (node, group, v) of an over-fine partition merged to `target` by average linkage of their centres, each named after the least group in it."""
    from skein.operators.vectors import centroids

    centre = centroids(members, "group").select(F.col("group").cast("bigint").alias("node"), F.col("c").alias("v"))
    to = coarsened(centre, target).select(F.col("node").alias("group"), "cluster")
    return members.select("node", "group").join(to, "group").select("node", F.col("cluster").alias("group"))
