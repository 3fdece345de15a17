"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat_format, fill_middle, fingerprints, language_id, line_dedup, mixing, ngram_join, quality_rules, sentencepiece_fst, substring_dedup, token_files, url_filters, vector_codes
from skein.llm.store import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return chat_format.rotate(read(spark, sf_dir, "conversations")).withColumn("spans", spans)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on the driver; executors get its contents from it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.filter("not held_out"))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.digest(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=90)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), to)
    return token_files.read_tokens(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(read(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    out = fill_middle.restore(fill_middle.transform(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_chat_format, op3_language_id, op4_fingerprints, op5_mixing, op6_sentencepiece, op7_ngram_join, op8_quality_rules, op9_token_files, op10_substring_dedup, op11_vector_codes, op12_line_dedup, op13_fill_middle)}
ORACLES = {"op1_url_filters": url_filters.ORACLE, "op2_chat_format": chat_format.ORACLE, "op7_ngram_join": ngram_join.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
