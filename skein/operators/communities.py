"""Groups of a weighted graph: connected components, modularity communities with a search for the resolution, and communities refined so that each is connected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint, not null). One row per node that an edge touches: node, comp (the least node reachable).

    Each round hooks a node's root to the least root among its neighbours and halves the way to the root; the number of
    rounds grows with the logarithm of the longest path. A hub's edges are minimised before they are shuffled. The way from a root on is looked up once for each
    root and salt, so that the nodes of one large component are spread.
    """
    both = staged(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    p = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("comp")), "labels")
    while True:
        least = both.join(p.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("m"))
        seen = p.join(least, "node").select("node", "comp", F.least("comp", "m").alias("m"))
        hooks = seen.filter("m < comp").groupBy(F.col("comp").alias("node")).agg(F.min("m").alias("h"))
        hooked = staged(seen.join(hooks, "node", "left").select("node", F.least("m", F.coalesce("h", "m")).alias("m"), "comp"), "hooked")
        salt = F.pmod(F.hash("node"), F.lit(32))
        roots = hooked.select("m", salt.alias("salt")).distinct()
        far = roots.join(hooked.select(F.col("node").alias("m"), F.col("m").alias("far")), "m")
        p2 = staged(hooked.withColumn("salt", salt).join(far, ["m", "salt"], "left").select("node", F.coalesce("far", "m").alias("m2"), "comp"), "labels")
        changed = p2.filter("m2 <> comp").limit(1).count()
        p = p2.select("node", F.col("m2").alias("comp"))
        if not changed:
            return p


def modularity(weights: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (node, label) on undirected pairs (a, b, w; loops count once): share of weight inside communities less resolution times what chance would put there."""
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    inside = weights.join(side("a"), "a").join(side("b"), "b").filter("la = lb").agg(F.sum("w")).first()[0] or 0.0
    ends = weights.select(F.col("a").alias("node"), "w").union(weights.select("b", "w")).groupBy("node").agg(F.sum("w").alias("k"))
    squares = ends.join(labels, "node").groupBy("label").agg(F.pow(F.sum("k"), F.lit(2.0)).alias("s")).agg(F.sum("s")).first()[0] or 0.0
    return inside / total - resolution * squares / (2 * total) ** 2


def _moved(both: DataFrame, strength: DataFrame, total: float, resolution: float, rounds: int, start: DataFrame | None = None) -> DataFrame:
    """node, label after rounds, from labels to start with or each node alone, in which one half of the nodes (by hash and round) each moves to the neighbouring community that adds most to modularity, if any does."""
    labels = start or staged(strength.select("node", F.col("node").alias("label")), "labels")
    quiet, now = 0, None
    for r in range(rounds):
        sizes = labels.join(strength, "node").groupBy("label").agg(F.sum("k").alias("size"))
        votes = both.filter("a <> b").join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        here = labels.join(strength, "node").select("node", F.col("label").alias("own"), "k")
        options = votes.union(here.select("node", F.col("own").alias("label"), F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
        rated = options.join(here, "node").join(sizes, "label").withColumn("others", F.col("size") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0))
        gain = F.round(F.col("w") - resolution * F.col("k") * F.col("others") / (2 * total), 9)
        best = rated.withColumn("g", gain).groupBy("node").agg(F.min(F.struct((-F.col("g")).alias("g"), (F.col("label") != F.col("own")).alias("moves"), "label"))["label"].alias("best"), F.first("own").alias("own"))
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        now = staged(best.select("node", F.when(turn, F.col("best")).otherwise(F.col("own")).alias("label"), (turn & (F.col("best") != F.col("own"))).alias("m")), "labels", replaces=now)
        quiet = 0 if now.filter("m").limit(1).count() else quiet + 1
        labels = now.select("node", "label")
        if quiet == 3:
            break
    return labels


def communities(weights: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 4) -> DataFrame:
    """node, label (its least node): communities of undirected pairs (a, b, w > 0) by modularity at a resolution, deterministic.

    Nodes move in rounds of joins; communities then become the nodes of a smaller graph, level by level, until nothing joins any more.
    """
    w = staged(weights.filter("w > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("double").alias("w")), "weights")
    total = w.agg(F.sum("w")).first()[0]
    ends = w.select(F.col("a").alias("node")).union(w.select("b")).distinct()
    member = staged(ends.select("node", F.col("node").alias("label")), "members")
    for _ in range(levels if total else 0):
        both = w.select("a", "b", "w").union(w.filter("a <> b").select("b", "a", "w"))
        strength = staged(w.select(F.col("a").alias("node"), "w").union(w.select("b", "w")).groupBy("node").agg(F.sum("w").alias("k")), "strength")
        labels = _moved(both, strength, total, resolution, rounds)
        if not labels.filter("node <> label").limit(1).count():
            break
        member = staged(member.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label")), "members")
        side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))  # noqa: B023, E731
        w = staged(w.join(side("a"), "a").join(side("b"), "b").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w")), "weights")
    least = member.groupBy("label").agg(F.min("node").alias("least"))
    return member.join(least, "label").select("node", F.col("least").alias("label"))


def communities_near(weights: DataFrame, target: int, tries: int = 8, low: float = 0.005, high: float = 400.0, **options) -> tuple[DataFrame, float]:
    """(communities, resolution): those whose number comes nearest to the target, by bisection of the resolution's logarithm in `tries` tries; fewer communities win among equals."""
    best = None
    for _ in range(tries):
        at = math.sqrt(low * high)
        found = communities(weights, at, **options)
        n = found.select("label").distinct().count()
        if best is None or (abs(n - target), n) < best[0]:
            best = ((abs(n - target), n), found, at)
        if n == target:
            break
        low, high = (at, high) if n < target else (low, at)
    return best[1], best[2]


def _refined(both: DataFrame, strength: DataFrame, labels: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """node, sub: parts of communities, each connected. From each node alone, in rounds, one half of those still alone each joins the part that adds most to modularity, if any does.

    Nodes and parts take part only while they are well tied to the rest of their community: by no less weight than chance, times the resolution, would tie them. Those that may move in a round are joined by no one in
    it, so a part only grows, by nodes that are tied to what stays in it.
    """
    community = labels.join(strength, "node").groupBy("label").agg(F.sum("k").alias("all"))
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    inside = staged(both.filter("a <> b").join(side("a"), "a").join(side("b"), "b").filter("la = lb").select("a", "b", "w"), "refine-edges")
    tied = inside.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("tie"))
    due = lambda k: F.round(resolution * k * (F.col("all") - k) / (2 * total), 9)
    node = staged(labels.join(strength, "node").join(community, "label").join(tied, "node", "left").select("node", "k", "all", (F.round(F.coalesce("tie", F.lit(0.0)), 9) >= due(F.col("k"))).alias("well")), "refine-nodes")
    subs, quiet = staged(node.select("node", F.col("node").alias("sub")), "subs"), 0
    for r in range(rounds):
        out = inside.join(subs.select(F.col("node").alias("a"), F.col("sub").alias("sa")), "a").join(subs.select(F.col("node").alias("b"), F.col("sub").alias("sb")), "b")
        ties = out.filter("sa <> sb").groupBy(F.col("sa").alias("sub")).agg(F.sum("w").alias("tie"))
        part = subs.join(node, "node").groupBy("sub").agg(F.sum("k").alias("size"), F.max("all").alias("all"), F.count("*").alias("n")).join(ties, "sub", "left")
        part = part.select("sub", "size", "n", (F.round(F.coalesce("tie", F.lit(0.0)), 9) >= due(F.col("size"))).alias("good"))
        moves = (F.col("n") == 1) & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        who = staged(subs.join(part, "sub").join(node.select("node", "k", "well"), "node").select("node", "sub", "k", "size", "good", (moves & F.col("well")).alias("moves")), "refine-who")
        to = who.filter("not moves and good").select(F.col("node").alias("b"), F.col("sub").alias("to"), "size")
        votes = inside.join(who.filter("moves").select(F.col("node").alias("a"), "k"), "a").join(to, "b").groupBy("a", "to").agg(F.sum("w").alias("w"), F.first("k").alias("k"), F.first("size").alias("size"))
        gain = F.round(F.col("w") - resolution * F.col("k") * F.col("size") / (2 * total), 9)
        best = staged(votes.withColumn("g", gain).filter("g > 0").groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("g")).alias("g"), "to"))["to"].alias("to")), "refine-moves")
        quiet = 0 if best.limit(1).count() else quiet + 1
        if quiet == 3:
            break
        subs = staged(subs.join(best, "node", "left").select("node", F.coalesce("to", "sub").alias("sub")), "subs")
    return subs


def connected_parts(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label (its least node): labels (node, label) cut into what is connected by pairs (a, b, w > 0) inside them. No cut lowers modularity."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    inside = weights.filter("w > 0").join(side("a"), "a").join(side("b"), "b").filter("la = lb")
    return labels.select("node").join(components(inside.select("a", "b")), "node", "left").select("node", F.coalesce("comp", "node").alias("label"))


def refined_communities(weights: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 6, start: DataFrame | None = None) -> DataFrame:
    """node, label (its least node): communities of undirected pairs (a, b, w > 0) by modularity, each of them connected; deterministic.

    From the labels to start with (those of `communities` if there are none) nodes move as there, but what becomes a node of the smaller graph is not a community but a part of one (`_refined`), and the communities are
    where its moves begin: so parts that a whole community would have tied together can still go apart. What is not connected is cut. Of this and the start, cut likewise, that of more modularity is given, so the result is never worse
    than the start.
    """
    w = staged(weights.filter("w > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("double").alias("w")), "weights")
    base, total = w, w.agg(F.sum("w")).first()[0]
    ends = w.select(F.col("a").alias("node")).union(w.select("b")).distinct()
    member = staged(ends.select("node", F.col("node").alias("sub")), "members")
    start = staged(ends.join(communities(base, resolution, rounds) if start is None else start, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    first = found = start
    for _ in range(levels if total else 0):
        both = w.select("a", "b", "w").union(w.filter("a <> b").select("b", "a", "w"))
        strength = staged(w.select(F.col("a").alias("node"), "w").union(w.select("b", "w")).groupBy("node").agg(F.sum("w").alias("k")), "strength")
        labels = _moved(both, strength, total, resolution, rounds, start)
        found = staged(member.join(labels.withColumnRenamed("node", "sub"), "sub").select("node", "label"), "found")
        subs = _refined(both, strength, labels, total, resolution, rounds)
        if not subs.filter("node <> sub").limit(1).count():
            break
        member = staged(member.join(subs.select(F.col("node").alias("sub"), F.col("sub").alias("up")), "sub").select("node", F.col("up").alias("sub")), "members")
        start = staged(labels.join(subs, "node").groupBy(F.col("sub").alias("node")).agg(F.min("label").alias("label")), "labels")  # all of a part have one label
        side = lambda x: subs.select(F.col("node").alias(x), F.col("sub").alias(f"s{x}"))  # noqa: B023, E731
        w = staged(w.join(side("a"), "a").join(side("b"), "b").groupBy(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).agg(F.sum("w").alias("w")), "weights")
    options = [staged(connected_parts(base, x), "found") for x in (first, found)]
    return max(options, key=lambda x: modularity(base, x, resolution))
