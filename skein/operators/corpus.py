"""Corpus construction: first-seen dedup, dense ids, change logs, merges, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from skein.sources.staging import staged


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """The row of the least position of each key. Partial minima go before the shuffle; there is no sort."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), position).alias("r")).select(key, "r.*").select(*df.columns)


def latest_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of the greatest position of each key."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), position).alias("r")).select(*keys, "r.*").select(*df.columns)


def dense_id(df: DataFrame, order: list[str], name: str = "node_id", parts: int | None = None) -> DataFrame:
    """df with ids 0, 1, ... in the order of `order`, whose values must be unique.

    Rows are range-partitioned and numbered inside their range, and written once, as a second evaluation could cut the ranges elsewhere; the sizes
    of the ranges, one number each, give the offsets. No task sees all rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id numbers a partition's rows in its lower 33 bits.
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = staged(numbered, "numbered")
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return numbered.join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_m")).drop("_p", "_m", "_b")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, position: str, deleted: str, in_scope: Column) -> DataFrame:
    """base after an ordered log: a key's last change removes it if it is deleted or out of scope, else replaces or adds it."""
    last = latest_wins(changes, [key], position)
    kept = last.filter(~F.col(deleted) & in_scope).select(*base.columns)
    return base.join(last.select(key), key, "left_anti").unionByName(kept)


def add_missing(existing: DataFrame, ids: DataFrame, key: str, placeholder: dict[str, Column]) -> DataFrame:
    """existing, and a placeholder row for each id that it lacks."""
    new = ids.select(key).distinct().join(existing.select(key), key, "left_anti")
    return existing.unionByName(new.select(key, *[v.alias(k) for k, v in placeholder.items()]), allowMissingColumns=True)


def compact(df: DataFrame, keep: Column, order: str, name: str = "node_id") -> DataFrame:
    """The rows to keep, numbered anew."""
    return dense_id(df.filter(keep).drop(name) if name != order else df.filter(keep).withColumnRenamed(name, "_old"), ["_old" if name == order else order], name)


def merge_corpora(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All rows of both, which share no key (else ValueError). A column that one lacks, or has as void, is null there with the other's type."""
    if a.join(b.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"both sides have the same {key}")
    types = {f.name: f.dataType for d in (a, b) for f in d.schema.fields if not isinstance(f.dataType, NullType)}
    widen = lambda d: d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    return widen(a).unionByName(widen(b))


def enrich(corpus: DataFrame, provider: DataFrame, key: str, replace: list[str], fill: list[str]) -> DataFrame:
    """corpus with the provider's columns: `replace` where the provider has a row and a value, `fill` where the corpus has none. Rows and ids stay.

    The provider has one row for each key at most; its arrays count as values if they have an element.
    """
    p = provider.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*replace, *fill)])
    kinds = dict(corpus.dtypes)
    has = lambda c: F.size(f"_{c}") > 0 if kinds[c].startswith("array") else F.col(f"_{c}").isNotNull()
    out = corpus.join(p, F.col(key) == F.col("_k"), "left")
    out = out.withColumns({c: F.when(has(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in replace} | {c: F.coalesce(c, f"_{c}") for c in fill})
    return out.select(*corpus.columns)


def best_candidate(candidates: DataFrame, key: str, score: list[str], row: list[str]) -> DataFrame:
    """For each key the candidate of the greatest score, a tuple of columns that must be unique in a key."""
    return candidates.groupBy(key).agg(F.max_by(F.struct(*row), F.struct(*score)).alias("r")).select(key, "r.*")


def route_cascade(wanted: DataFrame, key: str, routes: list[DataFrame]) -> DataFrame:
    """Matches of the first route that has a row for a key: key, route (from 1), value. Each later route sees only keys that are still open."""
    out, left = None, wanted.select(key).distinct()
    for n, r in enumerate(routes, 1):
        hit = left.join(r.filter(~F.col("value").rlike("[|,]")), key).groupBy(key).agg(F.lit(n).alias("route"), F.min("value").alias("value"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select(key), key, "left_anti")
    return out


def two_field_filter(works: DataFrame, year: Column, cites: Column, low: int, high: int, recent: int, most: int, key: str) -> DataFrame:
    """Works of the years low..high cited more than 25 times, and recent ones cited more than twice; the most-cited `most` of them."""
    old, new = works.filter(year.between(low, high) & (cites > 25)), works.filter((year >= recent) & (cites > 2))
    return old.unionByName(new).dropDuplicates([key]).orderBy(cites.desc(), key).limit(most)
