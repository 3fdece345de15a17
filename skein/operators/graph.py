"""Citation graph: edge resolution, projection, similarity neighbours, caps, tiers, relevance."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.staging import spread, staged


def resolve(references: DataFrame, corpus: DataFrame) -> DataFrame:
    """references: node_id, work. Edges src, dst to corpus (node_id, work) without self-loops; repeated references stay."""
    return references.select(F.col("node_id").alias("src"), "work").join(corpus.select("work", F.col("node_id").alias("dst")), "work").filter("src <> dst").select("src", "dst")


def project(adjacency: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges among known nodes of an adjacency table (key, neighbors). ids: outside, node_id, and may map an outside key to several nodes.

    Keys are filtered before their lists are exploded. Self-loops go; edges are distinct.
    """
    near = adjacency.join(ids.select(F.col("outside").alias("key")).distinct(), "key", "left_semi").select("key", F.explode("neighbors").alias("other"))
    src, dst = ids.select(F.col("outside").alias("key"), F.col("node_id").alias("src")), ids.select(F.col("outside").alias("other"), F.col("node_id").alias("dst"))
    return near.join(dst, "other").join(src, "key").filter("src <> dst").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out")), edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, refs, cited_by: sorted arrays, empty where a node has none in a direction."""
    refs = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("refs"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("cited_by"))
    none = F.array().cast("array<bigint>")
    return refs.join(back, "node", "full").select("node", F.coalesce("refs", none).alias("refs"), F.coalesce("cited_by", none).alias("cited_by"))


def shared_neighbours(edges: DataFrame, hub_cap: int = 0) -> DataFrame:
    """a, b, refs, citers: numbers of works that two nodes both cite, and that cite both (both orders of a pair).

    Pivots of more than hub_cap edges are left out (0: none is), which bounds the pairs that one pivot makes by hub_cap squared.
    """
    def through(pivot: str, end: str, name: str) -> DataFrame:
        e = edges.select(F.col(pivot).alias("p"), F.col(end).alias("x"))
        if hub_cap:
            e = e.join(e.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") <= hub_cap).select("p"), "p")
        return e.withColumnRenamed("x", "a").join(e.withColumnRenamed("x", "b"), "p").filter("a < b").select("a", "b", *[F.lit(int(name == c)).alias(c) for c in ("refs", "citers")])

    one = through("dst", "src", "refs").unionByName(through("src", "dst", "citers")).groupBy("a", "b").agg(F.sum("refs").alias("refs"), F.sum("citers").alias("citers"))
    orders = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")  # counted in one order, given in both
    return one.select(orders, "refs", "citers").select("e.a", "e.b", "refs", "citers")


def shared_of(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, refs, citers of the given pairs (a, b) alone, through pivots of any degree; 0 where none is shared."""
    pairs = staged(pairs.select("a", "b").distinct(), "shared-pairs")
    ends = staged(pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct(), "shared-ends")

    def through(pivot: str, end: str, name: str) -> DataFrame:
        e = edges.select(F.col(pivot).alias("p"), F.col(end).alias("x")).join(ends, "x", "left_semi")
        return pairs.join(e.withColumnRenamed("x", "a"), "a").join(e.withColumnRenamed("x", "b"), ["p", "b"]).groupBy("a", "b").agg(F.count("*").alias(name))

    both = pairs.join(through("dst", "src", "refs"), ["a", "b"], "left").join(through("src", "dst", "citers"), ["a", "b"], "left")
    return both.na.fill(0, ["refs", "citers"])


def citation_scores(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: a, b, refs, citers, direct if it is known, and columns that stay. Score 1 if one cites the other, else the mean of the Jaccard similarities of references and of citers."""
    out, in_ = degrees(edges)
    n = staged(out.join(in_, "node", "full").na.fill(0), "degrees")
    if "direct" not in pairs.columns:
        direct = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct().withColumn("direct", F.lit(True))
        pairs = pairs.join(direct, ["a", "b"], "left").na.fill(False, ["direct"])
    far = pairs.filter("not direct and refs + citers > 0")
    for x in ("a", "b"):
        far = far.join(n.select(F.col("node").alias(x), F.col("n_out").cast("int").alias(f"n_out_{x}"), F.col("n_in").cast("int").alias(f"n_in_{x}")), x)
    jac = lambda both, n: F.when(F.col(both) > 0, F.col(both) / (F.col(f"{n}_a") + F.col(f"{n}_b") - F.col(both))).otherwise(0.0)
    rest = [c for c in pairs.columns if c not in ("a", "b", "refs", "citers", "direct")]
    known = pairs.filter("direct or refs + citers = 0").select("a", "b", *rest, F.when(F.col("direct"), 1.0).otherwise(0.0).alias("score"))
    return known.unionByName(far.select("a", "b", *rest, (0.5 * (jac("refs", "n_out") + jac("citers", "n_in"))).alias("score")))


#: Ends in a list of a pivot's ends; of pivots with more, where no limit leaves them out, each end meets several lists.
LIST = 1000
#: Ends counted at once by a task.
COUNTED = 2_000_000


def _best_shared(limit: int):
    """The function of rows (a, l, kind), all of an a beside each other, that counts how often each b is in a's lists: of references (kind 0), of citers (1); those of kind 2 are directly linked, those of kind 3 asked for besides.

    Gives a, b, refs, citers, direct, beside of the `limit` greatest sums, then least b, and of all that are linked or asked for. Counts are merged whenever many ends have come, so a node of any degree needs the memory of its different partners.
    """
    def counted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return a[at], b[at], np.add.reduceat(n, at, axis=0, dtype=np.int32)

    def best(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        shared = n[:, 0] + n[:, 1]
        order = np.lexsort((b, -shared, a))
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        place = np.empty(len(a), np.int64)
        place[order] = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        keep = (place < limit) & (shared > 0) | (n[:, 2] > 0) | (n[:, 3] > 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[keep], b[keep], n[keep, 0], n[keep, 1], n[keep, 2] > 0, n[keep, 3] > 0)], names=["a", "b", "refs", "citers", "direct", "beside"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.int32)
        kept, waiting, ends = none, [], 0
        for batch in batches:
            size = np.diff(batch["l"].offsets.to_numpy())
            a, b = np.repeat(batch["a"].to_numpy(), size), batch["l"].flatten().to_numpy().astype(np.int64)
            other = a != b
            waiting.append((a[other], b[other], np.eye(4, dtype=np.int32)[np.repeat(batch["kind"].to_numpy(), size)[other]]))
            ends += len(a)
            if ends > max(COUNTED, len(kept[0])):
                kept, waiting, ends = counted(*(np.concatenate(x) for x in zip(kept, *waiting, strict=True))), [], 0
                last = batch["a"][-1].as_py()  # its lists may go on
                here = kept[0] != last
                yield best(*(x[here] for x in kept))
                kept = tuple(x[~here] for x in kept)
        rows = tuple(np.concatenate(x) for x in zip(kept, *waiting, strict=True))
        if len(rows[0]):
            yield best(*counted(*rows))

    return run


def _pivot_lists(edges: DataFrame, pivot: str, end: str, hub_cap: int, among: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(a, l; p, n): each end beside the lists of all ends of its pivots, but of those with more than hub_cap edges, which are given with their numbers (hub_cap 0: ends of pivots with more than LIST meet all of several lists)."""
    e = edges.select(F.col(pivot).alias("p"), F.col(end).alias("x"))
    hubs = staged(e.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > (hub_cap or LIST)), "hubs")
    of = lambda x: x if among is None else x.join(among.select(F.col("node").alias("a")), "a", "left_semi")
    lists = e.join(hubs, "p", "left_anti").groupBy("p").agg(F.collect_list("x").alias("l"))
    out = of(lists.select(F.explode("l").alias("a"), "l"))
    if not hub_cap and hubs.limit(1).count():
        big = e.join(hubs, "p")
        parts = big.groupBy("p", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / LIST)).alias("k")).agg(F.collect_list("x").alias("l")).drop("k")
        out = out.unionByName(of(big.select("p", F.col("x").alias("a"))).join(parts, "p").select("a", "l"))
    return out, hubs


def candidates_with_shares(edges: DataFrame, limit: int, hub_cap: int = 0, among: DataFrame | None = None, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, refs, citers, direct, beside; p, n; p, n): the `limit` nodes of the greatest number of shared works (then least id) of each node, or of each of `among` (node), all directly linked ones,
    and the pairs of the table `beside` (a, b), if there is one, which the column of that name marks; with them the cited and the citing pivots of more than hub_cap edges, which count in none of this.

    Each node's lists come to it whole, a list a pivot, and are counted where they come together; the pairs themselves are neither shuffled nor written.
    """
    most = lambda d, c: d.agg(F.max(c)).first()[0] or 0
    fits = max(most(edges, F.greatest(F.abs("src"), F.abs("dst"))), 0 if beside is None else most(beside, F.abs("b")))
    ids = "array<int>" if fits < 1 << 31 else "array<bigint>"
    refs, cited = _pivot_lists(edges, "dst", "src", hub_cap, among)
    citers, citing = _pivot_lists(edges, "src", "dst", hub_cap, among)
    linked = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    if among is not None:
        linked = linked.join(among.select(F.col("node").alias("a")), "a", "left_semi")
    linked = linked.groupBy("a").agg(F.collect_set("b").alias("l")) if hub_cap else linked.select("a", F.array("b").alias("l"))
    parts = [x.select("a", F.col("l").cast(ids).alias("l"), F.lit(k).alias("kind")) for k, x in enumerate((refs, citers, linked))]
    if beside is not None:
        parts.append(beside.groupBy("a").agg(F.collect_list("b").alias("l")).select("a", "l", F.lit(3).alias("kind")))
    each = functools.reduce(DataFrame.unionByName, [x.withColumn("l", F.col("l").cast(ids)) for x in parts])
    return each.repartition("a").sortWithinPartitions("a").mapInArrow(_best_shared(limit), "a bigint, b bigint, refs int, citers int, direct boolean, beside boolean"), cited, citing


def citation_candidates(edges: DataFrame, limit: int, hub_cap: int = 0, among: DataFrame | None = None) -> DataFrame:
    """a, b, overlap: the `limit` nodes of the greatest overlap (then least id), and all directly linked ones (overlap 0 if none is shared), of all nodes or of those of `among` (node)."""
    return candidates_with_shares(edges, limit, hub_cap, among)[0].select("a", "b", (F.col("refs") + F.col("citers")).cast("bigint").alias("overlap"))


def scored_candidates(edges: DataFrame, limit: int, hub_cap: int) -> DataFrame:
    """a, b, score: citation scores of all citation_candidates, with shared works of any degree: those of more than hub_cap edges are counted for the candidates alone."""
    edges = staged(edges, "edges")
    pairs, cited, citing = candidates_with_shares(edges, limit, hub_cap)
    pairs = staged(pairs.drop("beside"), "candidates")
    if cited.limit(1).count() or citing.limit(1).count():
        hub = edges.join(cited.select(F.col("p").alias("dst")), "dst", "left_semi"), edges.join(citing.select(F.col("p").alias("src")), "src", "left_semi")
        for e, pivot, end, name in ((hub[0], "dst", "src", "refs"), (hub[1], "src", "dst", "citers")):
            e = e.select(F.col(pivot).alias("p"), F.col(end).alias("x"))
            more = pairs.filter("not direct").select("a", "b").join(e.withColumnRenamed("x", "a"), "a").join(e.withColumnRenamed("x", "b"), ["p", "b"]).groupBy("a", "b").agg(F.count("*").cast("int").alias("more"))
            pairs = pairs.join(more, ["a", "b"], "left").withColumn(name, F.col(name) + F.coalesce("more", F.lit(0))).drop("more")
        pairs = staged(pairs, "candidates")
    return citation_scores(edges, pairs)


#: Vectors of a block that ends of pairs are looked up in, pairs multiplied at a time, and least number of blocks of first ends.
VECTORS, PRODUCTS, SPLIT = 65_536, 65_536, 8


def _cosines_of_block(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """pairs (a, b, ...) of both whose ends there is a vector (side 0 for a, 1 for b; node, v), with their dot products cut to 0..1."""
    pairs, side = pairs.combine_chunks(), vectors["side"].to_numpy()
    at, able, x = [], np.ones(len(pairs), bool), []
    for k, end in enumerate("ab"):
        here = vectors.filter(pa.array(side == k)).combine_chunks()
        nodes, ends = here["node"].to_numpy(), pairs[end].to_numpy()
        order = np.argsort(nodes, kind="stable")
        place = np.minimum(np.searchsorted(nodes, ends, sorter=order), max(len(nodes) - 1, 0))
        able &= nodes[order][place] == ends if len(nodes) else False
        at.append((order, place))
        v = here["v"].combine_chunks()
        x.append(v.flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1) if len(nodes) else np.zeros((0, 0)))
    rows = np.flatnonzero(able)
    cos = np.zeros(len(rows))
    for lo in range(0, len(rows), PRODUCTS):
        va, vb = (x[k][order[place[rows[lo : lo + PRODUCTS]]]].astype(np.float64) for k, (order, place) in enumerate(at))
        cos[lo : lo + PRODUCTS] = np.einsum("ij,ij->i", va, vb)
    return pairs.take(pa.array(rows)).drop_columns(["i", "j"]).append_column("cosine", pa.array(np.clip(cos, 0.0, 1.0)))


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of both whose ends there is a vector (node, v; unit), and `cosine`, the vectors' dot product cut to 0..1.

    Pairs are dealt by blocks of first and of second ends, and the blocks' vectors are copied to where the pairs are: a vector once for every block of the other side, not once a pair.
    """
    v = vectors.filter("v is not null").select(F.col("node").cast("bigint").alias("node"), "v")
    second = max(1, math.ceil(v.count() / VECTORS))
    first = max(second, SPLIT)
    deal = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = pairs.withColumn("i", deal("a", first)).withColumn("j", deal("b", second))
    of_a = v.withColumn("side", F.lit(0)).withColumn("i", deal("node", first)).withColumn("j", each(second))
    of_b = v.withColumn("side", F.lit(1)).withColumn("i", each(first)).withColumn("j", deal("node", second))
    kinds = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return dealt.groupBy("i", "j").cogroup(of_a.unionByName(of_b).groupBy("i", "j")).applyInArrow(_cosines_of_block, f"{kinds}, cosine double")


def _fused(pairs: DataFrame, alpha: float) -> DataFrame:
    return pairs.withColumn("score", F.round(alpha * F.col("cosine") + (1 - alpha) * F.coalesce("score", F.lit(0.0)), 6)).drop("cosine")


def fused_neighbours(text: DataFrame, cited: DataFrame, vectors: DataFrame, alpha: float = 0.6, k: int = 15) -> DataFrame:
    """a, b, score, rank: the k best of the candidates of both tables by alpha * cosine + (1 - alpha) * citation score, then least id.

    text: a, b. cited: a, b, score. vectors: node, v (unit).
    """
    pairs = text.select("a", "b").union(cited.select("a", "b")).distinct().filter("a <> b")
    return top_per(_fused(cosines(pairs.join(cited.select("a", "b", "score"), ["a", "b"], "left"), vectors), alpha), ["a"], [F.desc("score"), F.col("b")], k)


def fused_candidates(edges: DataFrame, text: DataFrame, vectors: DataFrame, limit: int, alpha: float = 0.6) -> DataFrame:
    """a, b, score, text: the fused scores of each vector's (node, v; unit) text candidates (a, b; text is true) and of its `limit` citation candidates and linked nodes that have a vector, through pivots of any degree.

    Shared works of all pairs are counted where the candidates are, so no pair is joined with its ends' lists.
    """
    pairs = candidates_with_shares(edges, limit, among=vectors, beside=text)[0]
    near = staged(cosines(pairs, vectors), "fused-candidates")
    return _fused(citation_scores(edges, near), alpha).withColumnRenamed("beside", "text")


def citation_totals(raw: DataFrame, known: DataFrame) -> DataFrame:
    """node, incoming, outgoing, internal: raw citations (src, dst) of known nodes (node) with repeats and unknown partners, and distinct known citers. Of a large table a task counts a bounded number of rows."""
    rows = raw.count()
    of = lambda d, side: d.join(known.withColumnRenamed("node", side), side, "left_semi")
    count = lambda d, side, name: spread(d.select(F.col(side).alias("node")), rows, "node").groupBy("node").agg(F.count("*").alias(name))
    inside = spread(of(of(raw.filter("src <> dst"), "dst"), "src").select("src", "dst"), rows, "dst").distinct()  # a node's are in one task, of which distinct makes use
    internal = inside.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("internal"))
    joined = known.join(count(of(raw, "dst"), "dst", "incoming"), "node", "left").join(count(of(raw, "src"), "src", "outgoing"), "node", "left").join(internal, "node", "left")
    return joined.na.fill(0, ["incoming", "outgoing", "internal"])


def citation_floor(papers: DataFrame, provided: DataFrame, edges: DataFrame) -> DataFrame:
    """node, cited_by, enumerable: the greatest of own count, provider count and citers in the corpus; whether the citers make it up."""
    own = papers.select("node", "cited").join(provided, "node", "left").join(degrees(edges)[1], "node", "left")
    inside = F.coalesce("n_in", F.lit(0))
    most = F.greatest(F.coalesce("cited", F.lit(0)), F.coalesce("provided", F.lit(0)), inside)
    return own.select("node", most.alias("cited_by"), (inside >= most).alias("enumerable"))


def cap_edges(edges: DataFrame, weight: DataFrame, most: int) -> DataFrame:
    """Edges among the first `most` of their source or of their target by the partner's weight (node, w), then id. 0: all."""
    if not most:
        return edges
    w = lambda x: weight.select(F.col("node").alias(x), F.col("w").alias(f"w_{x}"))
    ranked = (edges.join(w("src"), "src").join(w("dst"), "dst")
              .withColumn("ks", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w_dst"), "dst")))
              .withColumn("kd", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("w_src"), "src"))))
    return ranked.filter((F.col("ks") <= most) | (F.col("kd") <= most)).select("src", "dst")


def edge_tiers(edges: DataFrame, level: DataFrame) -> DataFrame:
    """tier, n, total: edges by the deeper level (node, level) of their ends, and those of all tiers up to it. Edges with an unknown end go."""
    lv = lambda x: level.select(F.col("node").alias(x), F.col("level").alias(f"l_{x}"))
    per = edges.join(lv("src"), "src").join(lv("dst"), "dst").groupBy(F.greatest("l_src", "l_dst").alias("tier")).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.orderBy("tier")))


def relevance(edges: DataFrame, cited: DataFrame, selected: int, most: int = 3000) -> DataFrame:
    """node, score, direction of the selected node's network: shared references and citers, and 1 if linked, over the greatest such sum; the node itself is 1.

    direction: ref if the selected node cites it, else citer. Only the `most` members of the greatest cited (node, cited) are scored; others have 0.
    """
    refs = edges.filter(F.col("src") == selected).select(F.col("dst").alias("node")).distinct()
    citers = edges.filter(F.col("dst") == selected).select(F.col("src").alias("node")).distinct()
    members = refs.withColumn("direction", F.lit("ref")).unionByName(citers.join(refs, "node", "left_anti").withColumn("direction", F.lit("citer"))).filter(F.col("node") != selected)
    ranked = members.join(cited, "node", "left").orderBy(F.coalesce("cited", F.lit(0)).desc(), "node").limit(most)
    e = edges.distinct()
    both_refs = e.join(refs.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("r"))
    both_citers = e.join(citers.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("c"))
    raw = ranked.join(both_refs, "node", "left").join(both_citers, "node", "left").select("node", (F.coalesce("r", F.lit(0)) + F.coalesce("c", F.lit(0)) + 1).alias("raw"))
    scored = raw.select("node", (F.col("raw") / F.max("raw").over(Window.partitionBy())).alias("score"))
    rows = members.join(scored, "node", "left").select("node", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), "direction")
    return rows.unionByName(edges.sparkSession.range(1).select(F.lit(selected).cast("bigint").alias("node"), F.lit(1.0).alias("score"), F.lit("self").alias("direction")))


def ambient(edges: DataFrame, per_mille: int) -> DataFrame:
    """A fixed sample of edges by a multiplicative hash of their ends in 32-bit arithmetic."""
    m32 = F.lit((1 << 32) - 1)
    low = lambda c, by: ((F.col(c).bitwiseAND(m32) + 1) * by).bitwiseAND(m32)
    h = low("src", 73856093).bitwiseXOR(low("dst", 19349663))
    return edges.filter(h % 1000 < per_mille)


def undirected(weights: DataFrame) -> DataFrame:
    """a, b, w: the greatest weight of each pair in either order, above 0 and without loops."""
    return weights.filter("a <> b and w > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))


def top_per(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order without ties, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
