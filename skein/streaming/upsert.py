"""Incremental ingest: change logs into a keyed table, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from skein.operators.corpus import apply_changes


class KeyedTable:
    """A Parquet table of one row per key in versions and buckets of keys; a version is published by writing its number and its buckets' folders, so a reader never sees half of one.

    A change rewrites the buckets alone that it touches; the others are taken over from the version before. `retire` deletes what no version to be kept refers to.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _published(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("v bigint, bucket int, at bigint").parquet(f"{self.path}/published")
        except AnalysisException:
            return None

    def version(self) -> int:
        p = self._published()
        return 0 if p is None else p.agg(F.max("v")).first()[0] or 0

    def _places(self, version: int) -> dict[int, int]:
        """The version that each bucket was written in; a row a bucket."""
        return {r.bucket: r["at"] for r in self._published().filter(F.col("v") == version).collect()}

    def read(self, version: int | None = None) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        parts = [f"{self.path}/_at={at}/_bucket={b}" for b, at in sorted(self._places(version or self.version()).items()) if at > 0]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def publish(self, rows: DataFrame, version: int, touched: list[int] | None = None) -> None:
        """Write the rows as the `touched` buckets (all) of a version, whose other buckets are those of the version before."""
        touched = list(range(self.buckets)) if touched is None else touched
        before = {} if self.version() == 0 else self._places(self.version())
        if not before:
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        to = f"{self.path}/_at={version}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(to)
        schema = StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])
        filled = {r["_bucket"] for r in self.spark.read.schema(schema).parquet(to).select("_bucket").distinct().collect()}  # numbers of buckets
        places = before | {b: version if b in filled else 0 for b in touched}
        state = [(version, b, at) for b, at in places.items()]
        self.spark.createDataFrame(state, "v bigint, bucket int, at bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/published")

    def apply(self, changes: DataFrame, batch: int, position: str, deleted: str) -> None:
        """Apply a micro-batch once: batch b makes version b + 2 out of the one before, and is skipped if that is published."""
        target = batch + 2
        if self.version() >= target:
            return
        touched = sorted(r.b for r in changes.select(self._bucket().alias("b")).distinct().collect())  # numbers of buckets
        if not touched:
            touched = [0]
        old = self.read(target - 1).filter(self._bucket().isin(touched))
        self.publish(apply_changes(old, changes, self.key, position, deleted, F.lit(True)), target, touched)

    def retire(self, keep: int = 2) -> None:
        """Delete the bucket folders that none of the last `keep` versions refers to."""
        last = self.version()
        used = {(at, b) for v in range(max(1, last - keep + 1), last + 1) for b, at in self._places(v).items()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        name = lambda at: int(at.getPath().getName().split("=")[1])
        for old in fs.listStatus(root):  # the versions that are still there
            if old.getPath().getName().startswith("_at="):
                for part in fs.listStatus(old.getPath()):
                    if part.getPath().getName().startswith("_bucket=") and (name(old), name(part)) not in used:
                        fs.delete(part.getPath(), True)


def upsert_stream(changes: DataFrame, table: KeyedTable, checkpoint: str, position: str, deleted: str) -> StreamingQuery:
    """Changes from a streaming source into the table; overlap is harmless, as a key's last change wins."""
    return (changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, b: table.apply(df, b, position, deleted)).start())


def windowed(events: DataFrame, key: str, ts: str, value: str, width: str) -> DataFrame:
    """key, window, n, v: number of events and sum of values per key and tumbling window, of a stream or a table."""
    return events.groupBy(key, F.window(ts, width).alias("window")).agg(F.count("*").alias("n"), F.sum(value).alias("v"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """windowed() of an event stream (user_id, ts, value); events later than `late` are left out."""
    return windowed(events.withWatermark("ts", late), "user_id", "ts", "value", width).withColumnRenamed("window", "w")
