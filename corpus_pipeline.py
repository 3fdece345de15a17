"""A corpus pipeline: language, near duplicates, shared passages, mixture, pieces.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import language_id, mixing, ngram_join, sentencepiece_fst, substring_dedup
from skein.llm.queries import tokenizer_file
from skein.llm.store import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on the documents not held out, does not reject."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    names = ["text" if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)]  # so names of docs cannot clash with the operator's
    kept = language_id.predict(docs.toDF(*names), model, names).filter("not rejected")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by a Jaccard similarity of 0.8 of five-word shingles."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in one document; n_chars follows the text."""
    out = substring_dedup.remove_passages(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mixing.mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the piece ids of each text."""
    return sentencepiece_fst.encode(docs, tokenizer_file("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("substring_dedup", shared_passages),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]

#: SQL has no hashes, models or tokenizers of this kind; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
