"""Layouts: which shard holds what, inverted lists, neighbour tables, import index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import without_version
from skein.operators.corpus import dense_id
from skein.operators.graph import top_per

#: Ids of a shard of each kind.
SIZES = {"points": 2048, "titles": 2048, "detail": 4096, "neighbours": 4096, "author_papers": 8000, "author_info": 2048, "org_nodes": 128, "authors": 120_000}


def with_shard(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.withColumn("shard", F.floor(F.col(key) / size))


def shard_sizes(rows: DataFrame, key: str, size: int) -> DataFrame:
    """shard, n, lo, hi: rows of each shard, its least and its greatest id."""
    return with_shard(rows, key, size).groupBy("shard").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def inverted(pairs: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """shard, key, <value>s: the values of each key in order, dealt to shards by key."""
    lists = pairs.select(key, value).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))
    return with_shard(lists, key, size).select("shard", key, f"{value}s")


def dense_shards(keys: DataFrame, key: str, size: int) -> DataFrame:
    """key, shard: keys numbered in order and dealt to shards of equally many."""
    return dense_id(keys.select(key), [key], "i").select(key, F.floor(F.col("i") / size).alias("shard"))


def author_chunks(authors: DataFrame, size: int = SIZES["authors"]) -> DataFrame:
    """authors (author_id, id, name, ...) with shard and verified: whether the id is more than a hash of the name."""
    return with_shard(authors, "author_id", size).withColumn("verified", ~F.col("id").startswith("arxiv-name:"))


def import_index(papers: DataFrame) -> DataFrame:
    """arxiv, node: papers by their arXiv id without version; papers without one are left out."""
    return papers.filter("coalesce(arxiv_id, '') <> ''").select(without_version(F.col("arxiv_id")).alias("arxiv"), "node")


def neighbour_table(pairs: DataFrame, k: int) -> DataFrame:
    """node, neighbours, scores: the k best of the pairs (node, nbr, score) as arrays of equal length; padding (nbr below 0) is left out."""
    best = top_per(pairs.filter("nbr >= 0"), ["node"], [F.desc("score"), F.col("nbr")], k)
    lists = best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr", "score"))).alias("a"))
    return lists.select("node", F.transform("a", lambda x: x["nbr"]).alias("neighbours"), F.transform("a", lambda x: x["score"]).alias("scores"))
