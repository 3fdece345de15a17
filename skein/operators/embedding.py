"""Vectors of texts without an outside model, their coverage, projection and clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import search_tokens
from skein.operators.stats import exact_quantiles


def hashed_vectors(texts: DataFrame, size: int = 256) -> DataFrame:
    """texts: node, text. node, v: unit vectors of hashed TF-IDF; a text without tokens has a zero vector."""
    tokens = texts.select("node", search_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    tf = HashingTF(numFeatures=size, inputCol="tokens", outputCol="tf").transform(tokens)
    weighed = IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf)
    return Normalizer(inputCol="w", outputCol="u").transform(weighed).select("node", vector_to_array("u").alias("v"))


def with_coverage(papers: DataFrame, given: DataFrame, texts: DataFrame, policy: str, least: float = 0.5, size: int = 256) -> DataFrame:
    """node, v for papers (node) by policy: `drop` those without a given vector, `fill` them from their text, or embed all anew if fewer than `least` have one (`auto`)."""
    have = papers.select("node").join(given, "node")
    if policy == "drop":
        return have
    if policy == "auto":
        n, m = papers.count(), have.count()
        if m < least * n:
            return hashed_vectors(papers.select("node").join(texts, "node"), size)
    missing = papers.select("node").join(given.select("node"), "node", "left_anti").join(texts, "node")
    return have.unionByName(hashed_vectors(missing, size))


def project(vectors: DataFrame) -> DataFrame:
    """node, x, y: the first two principal components, centred, scaled so that the 99th percentile of their size is 100."""
    v = vectors.select("node", array_to_vector("v").alias("f"))
    p = PCA(k=2, inputCol="f", outputCol="p").fit(v).transform(v).select("node", vector_to_array("p").alias("p")).select("node", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return Frozen.fit(p).apply(p)


class Frozen:
    """A map's centre and scale, kept so that later points land on the same map."""

    def __init__(self, cx: float, cy: float, scale: float):
        self.cx, self.cy, self.scale = cx, cy, scale

    @classmethod
    def fit(cls, points: DataFrame) -> Frozen:
        """points: node, x, y; ValueError if a coordinate is not finite."""
        c = points.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_if(F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")) | F.col("x").isNull() | F.col("y").isNull()).alias("bad")).first()
        if c.bad:
            raise ValueError("coordinates must be finite")
        away = points.select(F.explode(F.array(F.abs(F.col("x") - F.lit(c.x)), F.abs(F.col("y") - F.lit(c.y)))).alias("d"))
        s = exact_quantiles(away, "d", [0.99])[0]
        return cls(c.x or 0.0, c.y or 0.0, s if s and s > 0 else 1.0)

    def apply(self, points: DataFrame) -> DataFrame:
        at = lambda v, c: ((F.col(v) - F.lit(c)) / F.lit(self.scale) * 100).alias(v)
        return points.select("node", at("x", self.cx), at("y", self.cy))


def clusters(vectors: DataFrame, k: int | None = None, seed: int = 1) -> DataFrame:
    """node, cluster by k-means; k is max(8, floor(sqrt(n / 2))) if not given."""
    n = vectors.count()
    k = k or max(8, int((n / 2) ** 0.5))
    v = vectors.select("node", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    return KMeans(k=k, seed=seed, featuresCol="f", predictionCol="cluster").fit(v).transform(v).select("node", "cluster")


def save_index(vectors: DataFrame, centroids: list[list[float]], path: str) -> None:
    """An index of cells: a folder of Parquet for each, so that a search reads the cells that it probes."""
    from skein.operators.vectors import _cells

    vectors.withColumn("cell", _cells(F.col("v"), centroids)[0]).repartition("cell").write.partitionBy("cell").parquet(path)


def search_index(spark, path: str, centroids: list[list[float]], query: list[float], k: int, probes: int) -> DataFrame:
    """node, score of the k best of the query's nearest cells, whose folders alone are read."""
    from skein.functions.vectors import dot

    near = sorted(range(len(centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centroids[i], query, strict=True)))[:probes]
    q = F.array(*map(F.lit, query))
    return spark.read.parquet(path).filter(F.col("cell").isin(near)).select("node", F.round(dot(F.col("v"), q), 4).alias("score")).orderBy(F.desc("score"), "node").limit(k)
