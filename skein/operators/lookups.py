"""Joins that attach, translate and check: provider references, time-bounded claims, nearest in time, counts, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.staging import staged


def provider_references(references: DataFrame, papers: DataFrame) -> DataFrame:
    """node, paper, clashes: references (node, provider) translated to the corpus' papers (provider, position, paper).

    Of several papers with one provider id the one of the least position stands for all; clashes counts the others. A node's repeated references come once,
    references to what the corpus lacks are left out.
    """
    first = papers.groupBy("provider").agg(F.min_by("paper", "position").alias("paper"), (F.count("*") - 1).alias("clashes"))
    return references.select("node", "provider").distinct().join(first, "provider").select("node", "paper", "clashes")


#: Pairs of a block of rows that share a key, and most tasks of all blocks.
PAIRS, TASKS = 10_000_000, 2000


def crosswalk(corpus: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Distinct pairs of the other columns of both tables that share a key.

    Each side's rows are made distinct first. Where on one side what is beside the key has one key only, no pair can come twice, and the pairs, which may be far more than either side, are not shuffled.
    A key's rows of corpus are cut into blocks of about PAIRS pairs, and its ids go to every one, so that neither a frequent key nor few keys make heavy tasks.
    """
    corpus, ids = corpus.filter(F.col(key).isNotNull()).distinct(), ids.filter(F.col(key).isNotNull()).distinct()
    corpus, ids = staged(corpus, "crosswalk-corpus"), staged(ids, "crosswalk-ids")
    count = lambda d, name: d.groupBy(key).agg(F.count("*").alias(name))
    parts = F.least("_n", F.ceil(F.col("_n") * F.col("_m") / PAIRS))
    many = staged(count(corpus, "_n").join(count(ids, "_m"), key).select(key, parts.alias("_parts"), (F.col("_n") * F.col("_m")).alias("_pairs")), "crosswalk-keys")
    blocks = staged(many.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part")).withColumn("_block", F.monotonically_increasing_id()), "crosswalk-blocks")
    tasks = int(min(max(-(-(many.agg(F.sum("_pairs")).first()[0] or 0) // PAIRS), 1), TASKS))
    rest = lambda d: [c for c in d.columns if c != key]
    dealt = corpus.join(many.select(key, "_parts"), key).withColumn("_part", F.pmod(F.xxhash64(*rest(corpus)), "_parts")).join(blocks, [key, "_part"]).select("_block", *rest(corpus))
    copied = ids.join(blocks, key).select("_block", *rest(ids))
    pairs = dealt.repartition(tasks, "_block").join(copied.repartition(tasks, "_block").hint("shuffle_hash"), "_block").drop("_block")
    for side in (ids, corpus):
        if not side.groupBy(*rest(side)).agg(F.count("*").alias("keys")).filter("keys > 1").limit(1).count():
            return pairs
    return pairs.distinct()


def collapse(nodes: DataFrame, facts: DataFrame, any_of: dict[str, Column], most_of: dict[str, Column]) -> DataFrame:
    """One row per node of nodes (node): whether any of its facts (node, ...) has each of any_of, and the greatest of each of most_of; false and 0 without facts."""
    agg = facts.groupBy("node").agg(*[F.bool_or(c).alias(n) for n, c in any_of.items()], *[F.max(c).alias(n) for n, c in most_of.items()])
    return nodes.select("node").join(agg, "node", "left").select("node", *[F.coalesce(n, F.lit(False)).alias(n) for n in any_of], *[F.coalesce(F.col(n), F.lit(0).cast(dict(agg.dtypes)[n])).alias(n) for n in most_of])


def attach_counts(nodes: DataFrame, counts: DataFrame | None, name: str = "n") -> DataFrame:
    """nodes with the greatest count (node, name) of each node, 0 where it has none; without a table of counts all are 0."""
    if counts is None:
        return nodes.withColumn(name, F.lit(0).cast("bigint"))
    return nodes.join(counts.groupBy("node").agg(F.max(name).alias(name)), "node", "left").na.fill(0, [name])


def claims_in_time(authorship: DataFrame, claims: DataFrame, papers: DataFrame) -> DataFrame:
    """org, node, method: papers (node, date) of claimed authors (org, author, valid_from, valid_to, and provenance if there is one) inside the claim's time.

    Both bounds are included, a null bound is open; a paper without a date fits only a claim without bounds.
    """
    method = F.col("provenance") if "provenance" in claims.columns else F.lit("roster")
    near = authorship.select("node", "author").join(claims.select("org", "author", "valid_from", "valid_to", method.alias("method")), "author").join(papers.select("node", "date"), "node")
    since, until = F.col("valid_from").isNull() | (F.col("date") >= F.col("valid_from")), F.col("valid_to").isNull() | (F.col("date") <= F.col("valid_to"))
    return near.filter(F.coalesce(since & until, F.lit(False))).select("org", "node", "method").distinct()


def bridge(rows: DataFrame, address: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows joined to known (segment, ...) on the last path segment of an address, and addresses without one: address, n)."""
    keyed = rows.withColumn("segment", F.regexp_extract(address, r"([^/#]+)[/#]*$", 1))
    return keyed.join(known, "segment"), keyed.join(known.select("segment").distinct(), "segment", "left_anti").groupBy(address).agg(F.count("*").alias("n"))


def top_counts(counts: DataFrame, name: str, k: int) -> DataFrame:
    """The k rows of the greatest n, then least name."""
    return counts.orderBy(F.desc("n"), name).limit(k)


def nearest_in_time(rows: DataFrame, others: DataFrame | None = None, value: str | None = None) -> DataFrame:
    """rows (key, node, day) with the nearest other row of the same key: key, node, nearest, gap in days, and its `value` if asked for. Rows without one are left out.

    Of two equally near the one of the lesser node is taken. others: where to look (rows). The nearest row lies on the same day or on the day before or after in
    order, so two looks per day and key take the place of a join of all with all.
    """
    others = rows if others is None else others
    keep = ["node"] + ([value] if value else [])
    days = others.groupBy("key", "day").agg(F.min(F.struct(*keep)).alias("first"), F.array_sort(F.collect_list(F.struct(*keep))).alias("_all")).withColumn("two", F.slice("_all", 1, 2)).drop("_all")
    mine = rows.select("key", "day").distinct().withColumn("asked", F.lit(True))
    every = days.join(mine, ["key", "day"], "full")
    before, after = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("first").isNotNull(), F.struct("day", "first"))
    looked = every.withColumn("b", F.last(at, ignorenulls=True).over(before)).withColumn("a", F.first(at, ignorenulls=True).over(after)).filter("asked").select("key", "day", "two", "b", "a")
    each = rows.select("key", "node", "day").join(looked, ["key", "day"])
    same = F.try_element_at(F.filter("two", lambda x: x["node"] != F.col("node")), F.lit(1))
    option = lambda gap, x: F.struct(gap.cast("bigint").alias("gap"), x.alias("other"))
    options = F.filter(F.array(option(F.lit(0), same), option(F.col("day") - F.col("b.day"), F.col("b.first")), option(F.col("a.day") - F.col("day"), F.col("a.first"))), lambda o: o["other"].isNotNull())
    best = each.withColumn("best", F.array_min(options)).filter("best is not null")
    return best.select("key", "node", F.col("best.other.node").alias("nearest"), F.col("best.gap").alias("gap"), *([F.col(f"best.other.{value}").alias(value)] if value else []))


def not_in(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not live yet."""
    return rows.join(live.select(key), key, "left_anti")


def ancestors(tree: DataFrame, hops: int = 64) -> DataFrame:
    """leaf, ancestor, hops of every node of tree (id, parent): itself, its parent, and so on up to a node without a parent in the tree, `hops` steps at most.

    Each round joins the ends of the chains; a cycle ends with the bound.
    """
    up = tree.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    out = front = staged(tree.select(F.col("id").alias("leaf"), F.col("id").alias("ancestor"), F.lit(0).alias("hops")), "closure")
    known = tree.select(F.col("id").alias("next"))
    for k in range(1, hops + 1):
        front = staged(front.join(up, "ancestor").join(known, "next", "left_semi").select("leaf", F.col("next").alias("ancestor"), F.lit(k).alias("hops")), "closure")
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out


def members(authorship: DataFrame, affiliation: DataFrame) -> DataFrame:
    """org, node: distinct papers (node, author) of an organisation's authors (author, org)."""
    return authorship.join(affiliation, "author").select("org", "node").distinct()


def authoritative(papers: DataFrame, given: DataFrame) -> DataFrame:
    """papers (node, cited, available) with the given count (node, n) in place of their own where there is one; such a paper's count is available."""
    j = papers.join(given.select("node", "n"), "node", "left")
    return j.withColumn("available", F.col("n").isNotNull() | F.coalesce("available", F.lit(False))).withColumn("cited", F.coalesce("n", "cited")).drop("n")


def provider_materialise(papers: DataFrame, provider: DataFrame, primary: bool) -> DataFrame:
    """papers (node, cited, ...) with provider_cited, provider_available and, unless another source is primary already, cited from the provider (node, n)."""
    j = papers.join(provider.select("node", F.col("n").alias("provider_cited")), "node", "left").withColumn("provider_available", F.col("provider_cited").isNotNull())
    return j if primary else j.withColumn("cited", F.coalesce("provider_cited", "cited"))


def reference_counts(papers: DataFrame, references: DataFrame) -> DataFrame:
    """node, available, reference_count: papers (node, flag) with the number of their references (node, n).

    available is the flag, or whether there are references where it is null; the count of an unavailable list is -1.
    """
    known = papers.select("node", "flag").join(references.select("node", "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("available", F.coalesce("flag", F.col("n") > 0))
    return known.select("node", "available", F.when(F.col("available"), F.col("n")).otherwise(-1).alias("reference_count"))


def propagate(active: DataFrame, full: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """active with `columns` from full, in place of its own; rows and their number stay. ValueError if full lacks a key or has one twice."""
    side = full.select(key, *columns)
    if active.join(side, key, "left_anti").limit(1).count() or side.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"every {key} must be in the full table once")
    return active.drop(*columns).join(side, key, "left")


def wanted_only(rows: DataFrame, wanted: DataFrame, key: str, numbers: list[str] | None = None) -> DataFrame:
    """The rows of wanted keys; of those with `numbers`, only rows in which all of them are whole numbers, as such."""
    out = rows.join(wanted.select(key).distinct(), key, "left_semi")
    if not numbers:
        return out
    whole = {c: F.col(c).cast("string").try_cast("bigint") for c in numbers}
    return out.withColumns(whole).filter(" and ".join(f"{c} is not null" for c in numbers))


def similar_not_cited(similar: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """a, b, rank: of the similar pairs (a, b, s) those without a citation in either direction, the k best of each a, then least b."""
    linked = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return similar.join(linked, ["a", "b"], "left_anti").withColumn("rank", first).filter(F.col("rank") <= k).select("a", "b", "rank")


def similar_not_cited_among(vectors: DataFrame, edges: DataFrame, k: int = 5, within: str | None = None) -> DataFrame:
    """As similar_not_cited, of all vectors (node, v) with one value of `within`, by exact search: first for k and a few more of each node, then for twice as many of those for which citations took too many, until none is left."""
    from skein.operators.vectors import exact_neighbours

    wanted, out, open_ = 2 * k + 6, None, vectors
    while True:
        near = staged(exact_neighbours(open_, vectors, wanted, within=within).select(F.col("node").alias("a"), F.col("nbr").alias("b"), F.col("score").alias("s")), "similar")
        best = staged(similar_not_cited(near, edges, k), "similar-not-cited")
        full = near.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted)  # there may be more of it
        short = full.join(best.groupBy("a").agg(F.count("*").alias("m")), "a", "left").filter(F.coalesce("m", F.lit(0)) < k).select(F.col("a").alias("node"))
        done = best.join(short.withColumnRenamed("node", "a"), "a", "left_anti")
        out = done if out is None else out.unionByName(done)
        if not short.limit(1).count():
            return out
        open_, wanted = vectors.join(staged(short, "similar-open"), "node", "left_semi"), 2 * wanted


def neighbour_union(edges: DataFrame, chosen: list[int]) -> DataFrame:
    """node: what the chosen nodes cite or are cited by, without themselves."""
    out = edges.filter(F.col("src").isin(chosen)).select(F.col("dst").alias("node")).union(edges.filter(F.col("dst").isin(chosen)).select("src"))
    return out.distinct().filter(~F.col("node").isin(chosen))


def shard_over_tier(tier: DataFrame, shard: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) of loaded shards, and those of the tier whose source is not complete. complete: node; the shard's sources if not given."""
    done = (shard.select("src") if complete is None else complete.select(F.col("node").alias("src"))).distinct()
    return shard.unionByName(tier.join(done, "src", "left_anti"))


def merge_tiers(tiers: list[DataFrame]) -> DataFrame:
    """Edges (src, dst) of disjoint tiers, one after the other."""
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return out


def position_shards(points: DataFrame, nodes: DataFrame, size: int, most: int = 400) -> DataFrame:
    """The rows of all shards (node // size) that hold one of the nodes, `most` shards at most, the lowest ones."""
    shards = nodes.select(F.floor(F.col("node") / size).alias("shard")).distinct().orderBy("shard").limit(most)
    return points.withColumn("shard", F.floor(F.col("node") / size)).join(shards, "shard", "left_semi")


def bundle_violations(papers: DataFrame, edges: DataFrame, tables: dict[str, DataFrame] | None = None, version: int | None = None, wanted: int | None = None) -> DataFrame:
    """violation, n: what is wrong with a bundle (0: nothing): edges with an unknown end, node ids that are not 0 .. n - 1, row-aligned tables of another size, another schema version."""
    checks = [edges.join(papers.select(F.col("node").alias("dst")), "dst", "left_anti").agg(F.lit("edge end unknown").alias("violation"), F.count("*").alias("n")),
              edges.join(papers.select(F.col("node").alias("src")), "src", "left_anti").agg(F.lit("edge begin unknown").alias("violation"), F.count("*").alias("n")),
              papers.agg(F.lit("ids not dense").alias("violation"), (F.coalesce(F.max("node"), F.lit(-1)) + 1 - F.count_distinct("node")).alias("n")),
              papers.agg(F.lit("ids repeated").alias("violation"), (F.count("*") - F.count_distinct("node")).alias("n"))]
    size = papers.agg(F.count("*").alias("n"))
    for name, t in (tables or {}).items():
        checks.append(t.agg(F.count("*").alias("m")).crossJoin(size).select(F.lit(f"{name}: other number of rows").alias("violation"), F.abs(F.col("m") - F.col("n")).alias("n")))  # one row each
    if wanted is not None:
        checks.append(papers.sparkSession.range(1).select(F.lit("schema version").alias("violation"), F.lit(int(version != wanted)).cast("bigint").alias("n")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def related_links(selected: int, neighbours: DataFrame, points: DataFrame) -> DataFrame:
    """node, nbr, score and both positions (x, y, nx, ny) of the selected node's neighbours (node, nbr, score); neighbours without a position are left out."""
    at = lambda p, *names: points.select(*[F.col(c).alias(n) for c, n in zip(("node", "x", "y"), (p, *names), strict=True)])
    return neighbours.filter(F.col("node") == selected).select("node", "nbr", "score").join(at("nbr", "nx", "ny"), "nbr").join(at("node", "x", "y"), "node").select("node", "nbr", "score", "x", "y", "nx", "ny")
