"""Token ids in compressed files: frames of whole documents, coded by `token_coder` in independent blocks.

A frame holds the ids of some whole documents. It is a row of a Parquet table, so that any store and Spark's commit protocol serve: part and frame (its place), version, n_ids, nibbles (of the
largest id), docs (doc_id and place of the first id of each document), head_sum (a 64-bit hash of all this), body (the blocks, each with its length and the CRC-32 of its ids). A file is the
frames of one range of documents in ascending doc_id order. Blocks of a frame start anew every token_coder.BLOCK ids and depend on nothing else.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import token_coder
from skein.llm.store import bound_batches, broadcast_if_small
from skein.llm.textkit import chunks, column

#: Ids after which a frame ends at the next document.
FRAME_IDS = 1 << 17
VERSION = 2
_ROW = "part int, frame int, version int, n_ids bigint, nibbles int, docs array<struct<doc_id:bigint,begin:bigint>>"


def _head_sum() -> Column:
    return F.xxhash64("part", "frame", "version", "n_ids", "nibbles", "docs")


_tokenizers: dict[int, object] = {}


def _tokenizer(spec: str):
    """One for each file and Python worker. Spark runs as many workers as there are cores, so none starts threads of its own."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(spec)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer.from_str(spec)
    return _tokenizers[key]


def frames(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Rows of frames with packed ids in place of the body, from docs (doc_id, text) that lie as they shall be written."""
    bound_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, frame = _tokenizer(shared.value).encode_batch_fast, TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else struct.pack("<I", end_id)
        docs_, texts = [], []

        def flush() -> pa.RecordBatch:
            packed = b"".join(texts)
            ids, ends = np.frombuffer(packed, "<u4"), np.cumsum([0, *[len(t) // 4 for t in texts]])
            heads = pa.StructArray.from_arrays([pa.array(docs_, pa.int64()), pa.array(ends[:-1])], ["doc_id", "begin"])
            row = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([VERSION], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([token_coder.nibbles_of(ids)], pa.int32()),
                   pa.ListArray.from_arrays(pa.array([0, len(docs_)], pa.int32()), heads), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "frame", "version", "n_ids", "nibbles", "docs", "ids"])

        for batch in chunks(batches):
            for k in range(0, len(batch), 64):
                some = batch.slice(k, 64)
                docs_ += column(some, "doc_id").to_pylist()
                texts += [np.array(e.ids, "<u4").tobytes() + end for e in encode([t or "" for t in column(some, "text").to_pylist()], add_special_tokens=False)]
                if sum(map(len, texts)) >= 4 * FRAME_IDS:
                    yield flush()
                    docs_, texts, frame = [], [], frame + 1
        if docs_:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"{_ROW}, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, to: str, end_id: int | None = 2) -> None:
    """Encode the whole texts of docs (doc_id, text) with a tokenizers file, append end_id to each, and write the ids to the folder `to`.

    Null text is empty. Documents lie in ascending order of doc_id, null first, those of one doc_id in order of the bytes of their text. Ids are below token_coder.LIMIT, or ValueError. The file at `tokenizer` is
    read on the driver.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")  # ranges are cut by samples of the keys, so these stay short
    coded = frames(ordered, tokenizer, end_id).withColumn("body", token_coder.encoded(docs.sparkSession, F.col("ids"), F.col("nibbles"))).drop("ids")
    coded.withColumn("head_sum", _head_sum()).write.option("compression", "none").parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (packed little-endian 32-bit) of every document in a folder of files. What is not as it was written fails the query."""
    files = spark.read.schema(f"{_ROW}, body binary, head_sum bigint").parquet(path)
    per = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = per.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))  # a row a file
    starts = files.select("part", "frame", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("frame"))), F.lit(0))).join(parts, "part")
    offsets = starts.select("part", "frame", (F.col("base") + F.col("inside")).alias("offset"))
    ends = F.concat(F.slice(F.transform("docs", lambda x: x["begin"]), 2, F.greatest(F.size("docs") - 1, F.lit(0))), F.array("n_ids"))
    whole = F.when((F.col("head_sum") == _head_sum()) & (F.col("version") == VERSION), F.arrays_zip("docs", ends.alias("end"))).otherwise(F.raise_error(F.lit("damaged frame head")))
    frame = files.join(broadcast_if_small(offsets), ["part", "frame"]).select("offset", whole.alias("docs"), token_coder.decoded(spark, F.col("n_ids"), F.col("body"), F.col("nibbles")).alias("ids"))
    each = frame.select("offset", "ids", F.explode("docs").alias("x")).select("offset", "ids", F.col("x.docs.doc_id").alias("doc_id"), F.col("x.docs.begin").alias("begin"), (F.col("x.end") - F.col("x.docs.begin")).alias("n"))
    return each.select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), F.col("n").alias("n_tokens"), F.substring("ids", (4 * F.col("begin") + 1).cast("int"), (4 * F.col("n")).cast("int")).alias("ids"))
