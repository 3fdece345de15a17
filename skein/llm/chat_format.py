"""Perspective rotation of multi-party dialogues. Column expressions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as named
users; turns of the role `system` are context in every rendering and no participant. The mask covers what the assistant
says and the end sign after it. A rendering is cut into blocks of BLOCK turns, one row each, so that a conversation of any
length stays within a row's bounds; its blocks in order are the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Turns are counted in spans of turn numbers so long before the counts are summed up per conversation.
SPAN = 64
END = "<|end|>"


def positions(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with pos: place in the conversation by turn (null first), role and text, from 0.

    A conversation's rows are numbered in spans, whose sizes alone are summed over the whole conversation. A window holds a span's rows: SPAN of them where turn numbers differ, and as
    many as repeat a number, or have none, where they do not.
    """
    span = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 60)))
    rows = turns.withColumn("span", span)
    upto = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("_c"), F.col("span").alias("_s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (rows.withColumn("k", F.row_number().over(inside)).join(base, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("span") == F.col("_s")))
            .withColumn("pos", F.col("base") + F.col("k") - 1).drop("_c", "_s", "span", "base", "k"))


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation, participant and block: conv_id, speaker, block, n_turns, text, spans.

    spans: array of (begin, end) code-point places in the block's text that the assistant is to learn. Null role: `unknown`; null
    text: empty; null conv_id: a conversation like others; repeated rows: turns that follow each other. A conversation of system turns alone has no
    participant and no row.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    people = turns.filter("role <> 'system'").select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    blocks = (positions(turns).groupBy("conv_id", F.floor(F.col("pos") / block).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")))
    seen = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("_c")))
    mine = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(mine(t), F.lit("<|assistant|>\n")).when(t["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), t["role"], F.lit("|>\n")))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), mine(t).alias("mine")))
    rendered = seen.withColumn("parts", parts)
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + 1
    walk = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")), lambda acc, x: F.struct(
        (acc["at"] + size(x)).alias("at"),
        F.when(x["mine"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("begin"), (acc["at"] + size(x) - 1).alias("end"))))).otherwise(acc["spans"]).alias("spans")))
    return rendered.select("conv_id", "speaker", F.col("block").cast("long").alias("block"), F.size("turns").cast("long").alias("n_turns"),
                           F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"), walk["spans"].alias("spans"))


#: DuckDB SQL for rotate() with spans as text, `begin-end` joined by commas.
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, p.speaker, pos // {BLOCK} AS block, pos, t.role = p.speaker AS mine, text || '{END}' AS body,
        CASE WHEN t.role = p.speaker THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user:' || t.role || '|>' || chr(10) END AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM r)
SELECT conv_id, speaker, block::BIGINT AS block, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
  coalesce(string_agg((begins + length(head))::BIGINT::VARCHAR || '-' || (begins + length(head) + length(body))::BIGINT::VARCHAR, ',' ORDER BY pos) FILTER (WHERE mine), '') AS spans
FROM s GROUP BY conv_id, speaker, block
"""
