"""Tables written to the shared folder between two jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: Rows that a task of a table that `spread` deals holds, about.
TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on this machine. RuntimeError on a cluster without one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def relieve(spark: SparkSession) -> bool:
    """Have the driver collect its garbage if its heap has grown beyond half of what it may take; whether it did. Plans, broadcasts and places of shuffled blocks of jobs that are over stay until then, and a heap that may grow is
    otherwise enlarged rather than collected."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() <= heap.maxMemory():
        return False
    gc.collect()  # what Python refers to, the JVM keeps
    heap.gc()
    return True


def staged(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: everything after it sees one and the same evaluation, and starts from the files, whatever executors are lost.

    replaces: a table that `staged` gave and that nothing reads any more once df is written, as in a loop's last round; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    old = getattr(replaces, "_staged_at", None)
    if old:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def observed(df: DataFrame, name: str, replaces: DataFrame | None = None, **counts: Column) -> tuple[DataFrame, dict]:
    """(staged(df), aggregates of its rows by name), both by one job. A task that runs twice may count twice, so only whether there is any may hang on a count."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name, replaces)
    return out, seen.get


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of at most so many rows, dealt by keys, so that what is grouped by them after it holds about TASK_ROWS rows a task however large the table is; partitions by bytes alone hold many millions of rows of two
    numbers each. A table of a few times TASK_ROWS is left as it is."""
    return df if rows <= 4 * TASK_ROWS else df.repartition(-(-rows // TASK_ROWS), *keys)
