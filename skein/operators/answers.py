"""Checks of generated answers: refusal by the best score, citations, sentences without one, support by their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine01

#: A question whose best source is less like it than this is refused.
GATE = 0.78


def gate(questions: DataFrame, threshold: float = GATE) -> DataFrame:
    """questions with refused: whether top1, the best source's score, is below the threshold; without a source, too."""
    return questions.withColumn("refused", F.coalesce(F.col("top1") < threshold, F.lit(True)))


def citations(answers: DataFrame, sources: int) -> DataFrame:
    """answers (refused, answer) with cited (different numbers in brackets), valid (those from 1 to `sources`) and uncited_sentences; null where refused."""
    number = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    cited = F.array_distinct(F.array_compact(number))
    bare = F.filter(F.split("answer", r"(?<=[.!?])\s+"), lambda s: (F.trim(s) != "") & ~F.contains(s, F.lit("[")))
    given = lambda c: F.when(~F.col("refused"), F.size(c))
    return answers.withColumns({"cited": given(cited), "valid": given(F.filter(cited, lambda x: x.between(1, sources))), "uncited_sentences": given(bare)})


def validity(checked: DataFrame) -> DataFrame:
    """answered, refused, validity: numbers of answers, and the share of valid ones among all citations (1 if there is none)."""
    return checked.agg(F.count_if(~F.col("refused")).alias("answered"), F.count_if("refused").alias("refused"), F.round(F.coalesce(F.sum("valid") / F.nullif(F.sum("cited"), F.lit(0)), F.lit(1.0)), 6).alias("validity"))


def support(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """answer, sentence, support: cosine of each cited sentence (answer, sentence, source, v) with the best of the sources that it names (answer, source, w)."""
    pairs = sentences.join(sources, ["answer", "source"]).withColumn("s", F.round(cosine01(F.col("v"), F.col("w")), 5))
    return pairs.groupBy("answer", "sentence").agg(F.max("s").alias("support"))


def false_refusals(checked: DataFrame) -> DataFrame:
    """group, answered, refused of checked questions (group: whether the corpus can answer them, refused)."""
    return checked.groupBy("group").agg(F.count_if(~F.col("refused")).alias("answered"), F.count_if("refused").alias("refused"))


def best_sources(scores: DataFrame, k: int) -> DataFrame:
    """question, source, score, rank: the k best sources of each question."""
    first = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "source"))
    return scores.withColumn("rank", first).filter(F.col("rank") <= k)
