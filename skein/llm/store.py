"""Lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.textkit import release
from skein.sources.staging import shared_dir
from skein.sources.staging import staged as cut

__all__ = ["bound_batches", "broadcast_if_small", "cut", "looked_up", "shared_dir", "tidy"]

#: Rows that a side may have to be broadcast; rows are a few numbers wide.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df, which is materialised already, has at most `rows` rows; beyond that the plan shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined with the materialised table on keys that are not null, whatever share of the rows one key has. table: one row a key; weight: how many of the rows have the key.

    A table of at most BROADCAST_ROWS is broadcast. Of a larger one the keys that have a BROADCAST_ROWS-th of the rows or more are, as there can be no more than so many of them; all others meet by
    a shuffle, in which no key is heavier than that.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(weight)), on)
    floor = (table.agg(F.sum(weight)).first()[0] or 0) / BROADCAST_ROWS
    heavy = F.broadcast(table.filter(F.col(weight) >= floor).drop(weight))
    light = table.filter(F.col(weight) < floor).drop(weight)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on))


#: Bytes of one batch of rows between the JVM and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, as texts of any length are in them; a smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, None)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(setting: str | None) -> int:
    digits = "".join(c for c in setting or "" if c.isdigit())
    return int(digits) if setting and setting == digits else 1 << 31


def tidy(spark: SparkSession) -> None:
    """Have the driver let go of the plans, generated classes and Python objects of what has run: an operator of many jobs leaves hundreds of each behind, and a long session adds them up."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    release()
