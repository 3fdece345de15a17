"""The roles that the driver's tables play: papers are orders, citations run from an order to the order of the part's number, authors are suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """node, date (string), year, topic, field, cited."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.year("o_orderdate").alias("year"),
                                            F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("field"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("cited"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """src, dst as they come, with repeats and self-loops."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    c = citations(spark, d)
    return spread(c.filter("src <> dst"), c.count(), "src", "dst").distinct()


def authorship(spark: SparkSession, d: str) -> DataFrame:
    """node, author: distinct."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("author"))
    return spread(a, a.count(), "node", "author").distinct()


def titles(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, title (first line), lang, source, n_chars."""
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "lang", "source", "n_chars")


#: The same in SQL.
PAPERS = "papers AS (SELECT o_orderkey AS node, strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate)::INT AS year, o_orderpriority AS topic, o_orderstatus AS field, floor(o_totalprice / 1000)::BIGINT AS cited FROM orders)"
CITATIONS = "citations AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
EDGES = "edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey)"
AUTHORSHIP = "authorship AS (SELECT DISTINCT l_orderkey AS node, l_suppkey AS author FROM lineitem)"
TITLES = "titles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, lang, source, n_chars FROM documents)"
