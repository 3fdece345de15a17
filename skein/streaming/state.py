"""Keyed state of streams: the last change of each key, and running sums kept in a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from skein.streaming.upsert import KeyedTable

#: The state store that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """A key's last change, by position; a deleted key is remembered, so that an older change that comes late doesn't bring it back."""

    def __init__(self, key: str, position: str, deleted: str, columns: list[str], time: str | None, forget_ms: int):
        self.key, self.position, self.deleted, self.columns, self.time, self.forget_ms = key, position, deleted, columns, time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("position", LongType()), StructField("deleted", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            top = part.loc[[part[self.position].idxmax()]]
            if best is None or top[self.position].iloc[0] > best[self.position].iloc[0]:
                best = top
        at, gone = int(best[self.position].iloc[0]), bool(best[self.deleted].iloc[0])
        if self.last.exists() and self.last.get()[0] >= at:
            return
        if self.time:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if gone:
                self.handle.registerTimer(int(best[self.time].iloc[0].timestamp() * 1000) + self.forget_ms)
        self.last.update((at, gone))
        yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1]:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_changes(changes: DataFrame, key: str, position: str, deleted: str, time: str | None = None, late: str = "1 hour", forget_s: int = 86_400) -> DataFrame:
    """Of a stream of changes, those that are later (by `position`, a whole number) than all of their key before: of each batch the last.

    Repeated and late changes give nothing, in the same batch or any later one, also after a restart from the checkpoint. One row of state a key. With a time column (a timestamp, of which rows come `late` at most) the state of a deleted key
    goes by a timer, `forget_s` seconds after the deletion as the stream's watermark counts them; without one it stays. The session's state store has to be PROVIDER.
    """
    processor = _Latest(key, position, deleted, changes.columns, time, 1000 * forget_s)
    marked = changes.withWatermark(time, late) if time else changes
    return marked.groupBy(key).transformWithStateInPandas(processor, changes.schema, "Update", "EventTime" if time else "None")


def running_sums(rows: DataFrame, table: KeyedTable, checkpoint: str, values: list[str]) -> StreamingQuery:
    """n and the sums of `values` per key of all rows of a stream so far, in a keyed table whose rows are key, n and the values.

    The aggregate is state of the stream and gives the changed keys of each batch (update mode). The table takes a batch's rows as a version of its own, once: a batch that is run again after a failure
    finds its version published.
    """
    sums = rows.groupBy(table.key).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])

    def put(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            df.count()  # all of the state is committed, also where the table has the batch already
            table.apply(df.withColumn("_position", F.lit(batch)).withColumn("_gone", F.lit(False)), batch, "_position", "_gone")
        finally:
            df.unpersist()

    return sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
