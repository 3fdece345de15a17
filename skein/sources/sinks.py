"""Small artefacts for clients, written by the driver, and the bundle of tables that they belong to.

What goes through the driver here is bounded by `most` rows, and more raise: these are the little files that a client loads whole. Tables go to Parquet shards
(`readers.write_shards`).
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import arxiv_in, without_version

#: Rows that the driver takes for a client's file.
MOST_ROWS = 1_000_000


def _bounded(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write shards instead")
    return df


def write_arrow(df: DataFrame, path: str, order: list[str], most: int = MOST_ROWS) -> None:
    """One uncompressed Arrow file, in an order, as browsers read it."""
    table = _bounded(df, most).orderBy(*order).toArrow()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    feather.write_feather(table, path, compression="uncompressed")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(feather.read_table(path))


def write_json(value: Any, path: str) -> None:
    """Compact JSON with letters of all languages as they are. value: plain data, an object with model_dump(), or a DataFrame of bounded size (an array of its rows)."""
    if isinstance(value, DataFrame):
        value = [r.asDict(recursive=True) for r in _bounded(value, MOST_ROWS).collect()]
    elif hasattr(value, "model_dump"):
        value = value.model_dump(mode="json")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, separators=(",", ":")), encoding="utf-8")


def read_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_npy(df: DataFrame, path: str, vector: str, order: str, most: int = MOST_ROWS) -> None:
    """The vectors of a column as one array file, a row each, in an order."""
    table = _bounded(df, most).select(order, F.col(vector).cast("array<float>").alias("v")).orderBy(order).toArrow()
    lists = table.column("v").combine_chunks()
    flat = lists.values if isinstance(lists, pa.ListArray) else pa.concat_arrays([c.values for c in table.column("v").chunks])
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    np.save(path, np.asarray(flat, np.float32).reshape(len(table), -1))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """node, v of an array file, which is mapped, not read whole; node is the row's place."""
    rows = np.load(path, mmap_mode="r")
    return spark.createDataFrame(pa.table({"node": pa.array(np.arange(len(rows))), "v": pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))}))


def shard_name(kind: str, node: int, size: int) -> str:
    """Name of the shard that holds an id."""
    return f"{kind}-{node // size}"


def load_bundle(spark: SparkSession, tables: dict[str, str], views: str = "") -> dict[str, DataFrame]:
    """The tables of a bundle (name to folder), read lazily, each also a temporary view of its name after the prefix `views` if there is one."""
    out = {name: spark.read.parquet(path) for name, path in tables.items()}
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(views + name)
    return out


def eager_levels(points: DataFrame, eager: int = 5) -> tuple[DataFrame, DataFrame]:
    """Points of the first levels, which a client loads at once, and the rest."""
    return points.filter(F.col("level") < eager), points.filter(F.col("level") >= eager)


def papers_table(corpus: DataFrame) -> DataFrame:
    """A row a paper: ids, title, date, venue, counts and lists; empty texts are null."""
    filled = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return corpus.select(F.col("node_id").cast("int").alias("node_id"), "paper_id", "title", "publication_date", filled("doi"), filled("arxiv_id"), filled("venue"), F.col("cited_by_count").cast("int").alias("cited_by_count"),
                         F.col("topic_id").cast("int").alias("primary_topic_id"), F.coalesce("author_ids", F.array().cast("array<int>")).alias("author_ids"), "author_names")


def papers_index(corpus: DataFrame, floor: DataFrame, references: DataFrame, figures: DataFrame) -> DataFrame:
    """node_id, cited_by_count, year, citation_count_available, references_available, has_figure.

    floor: node, cited_by, enumerable (graph.citation_floor). references: node, available. figures: node. corpus: node_id, year, available (null: false).
    """
    f = floor.select(F.col("node").alias("node_id"), "cited_by", "enumerable")
    r = references.select(F.col("node").alias("node_id"), F.col("available").alias("refs"))
    j = corpus.select("node_id", "year", "available").join(f, "node_id", "left").join(r, "node_id", "left").join(figures.select(F.col("node").alias("node_id"), F.lit(True).alias("fig")).distinct(), "node_id", "left")
    flag = lambda *c: sum((F.coalesce(F.col(x), F.lit(False)).cast("int") for x in c), F.lit(0)) > 0
    return j.select(F.col("node_id").cast("int").alias("node_id"), F.coalesce("cited_by", F.lit(0)).cast("int").alias("cited_by_count"), F.col("year").cast("short").alias("year"), flag("available", "enumerable").alias("citation_count_available"), flag("refs").alias("references_available"), flag("fig").alias("has_figure"))


def paper_detail(corpus: DataFrame, references: DataFrame) -> DataFrame:
    """What is shown of one paper: ids, date, venue, authors and reference_count (references: node, reference_count; -1 if unknown)."""
    filled = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    r = references.select(F.col("node").alias("node_id"), "reference_count")
    return corpus.join(r, "node_id", "left").select(F.col("node_id").cast("int").alias("node_id"), "paper_id", "publication_date", filled("doi"), filled("arxiv_id"), filled("venue"), "author_names", F.coalesce("author_ids", F.array().cast("array<int>")).alias("author_ids"), F.coalesce("reference_count", F.lit(-1)).cast("int").alias("reference_count"))


def library_items(collections: DataFrame, members: DataFrame, deleted: DataFrame, items: DataFrame, lists: list[str], skip: tuple[str, ...] = ("attachment", "note", "annotation")) -> DataFrame:
    """list, item: items (item, parent, type) of the collections (id, parent, name) of given names and of all collections below them (members: collection, item), each once a list.

    Deleted items (item), items that hang on another one and those of the skipped types are left out.
    """
    from skein.operators.lookups import ancestors

    roots = collections.filter(F.col("name").isin(lists)).select(F.col("id").alias("ancestor"), F.col("name").alias("list"))
    below = ancestors(collections.select("id", "parent")).join(roots, "ancestor").select(F.col("leaf").alias("collection"), "list").distinct()
    kept = items.filter(F.col("parent").isNull() & ~F.col("type").isin(*skip)).join(deleted.select("item"), "item", "left_anti").select("item")
    return members.join(below, "collection").join(kept, "item", "left_semi").select("list", "item").distinct()


def csl_items(rows: DataFrame) -> DataFrame:
    """id, csl (JSON) of items: id, type, added, title, date, doi, url, venue, extra, creators (array of family, given), tags (array).

    The date's year, month and day as far as it has them; the arXiv id from extra, address and DOI; what is empty is left out.
    """
    parts = F.transform(F.array_compact(F.array(*[F.nullif(F.regexp_extract("date", r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", k), F.lit("")) for k in (1, 2, 3)])), lambda x: x.cast("int"))
    arxiv = F.coalesce(arxiv_in(F.col("extra")), arxiv_in(F.col("url")), arxiv_in(F.col("doi")))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    item = F.struct(F.col("id"), F.when(F.col("type") == "journalArticle", "article-journal").otherwise("article").alias("type"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.col("creators").alias("author"),
                    F.when(F.size(parts) > 0, F.struct(F.array(parts).alias("date-parts"))).alias("issued"), text("doi").alias("DOI"), text("url").alias("URL"), text("venue").alias("container-title"),
                    F.struct(F.substring(F.coalesce("added", F.lit("")), 1, 10).alias("added"), without_version(arxiv).alias("arxiv_id"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags")).alias("custom"))
    return rows.select("id", F.to_json(item).alias("csl"))


def csl_envelope(items: DataFrame, lists: list[str], name: str, exported_at: str) -> dict:
    """A reading list's document: items (list, id, csl) in the order of the lists, an item that is in several in the first of them alone; ValueError beyond MOST_ROWS."""
    order = F.array_position(F.array(*map(F.lit, lists)), F.col("list"))
    first = items.withColumn("o", order).filter("o > 0").groupBy("id").agg(F.min(F.struct("o", "list", "csl")).alias("x")).select("id", "x.*")
    out = []
    for r in _bounded(first, MOST_ROWS).orderBy("o", "id").collect():
        item = json.loads(r.csl)
        item.setdefault("custom", {})["list"] = r.list
        out.append(item)
    return {"format": name, "version": 1, "exported_at": exported_at, "lists": [{"name": n, "count": sum(i["custom"]["list"] == n for i in out)} for n in lists], "items": out}


#: What a published bundle leaves out.
LOCAL_ONLY = ("*.tmp", "*.log", "_temporary/*", ".*")


def resume_state(done: DataFrame, wanted: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """The wanted keys that a job of this fingerprint (done: fingerprint, key) has not finished."""
    return wanted.select(key).distinct().join(done.filter(F.col("fingerprint") == fingerprint).select(key), key, "left_anti")
