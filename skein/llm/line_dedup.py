"""Lines that many documents share: exploded, hashed, counted by document, dropped beyond a threshold, and the rest put together by position.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Only hashes of keys (128 bits) and numbers are exploded and shuffled; the lines travel
once, beside the positions to drop. A key that most documents hold is counted by partial sums, and its fate reaches its lines by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.store import cut, looked_up

_WHITE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """A line's key. Lower-casing is A-Z alone: of a line of ASCII that is all there is to lower, and others are translated."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id, the least number for null), th (hash of the text, which tells rows of one doc_id apart), lines."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))


def drop_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept for each row of docs (doc_id, text).

    A key of `least_chars` code points or more that `least_docs` different doc_ids or more hold loses all its lines, but for those of the largest doc_id that holds it; what is left is joined by
    newlines. A null or empty text is one empty line; a text may lose all its lines and is then empty. Rows without doc_id count as one document before all others; rows of one doc_id are one
    document, and each keeps or loses its lines as the others do. Other columns are not read.
    """
    rows = _rows(docs)
    line = rows.select("d", "th", F.posexplode("lines").alias("pos", "line")).select("d", "th", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    hashed = line.select("d", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    held = hashed.groupBy("h1", "h2", "d").agg(F.count("*").alias("n"))
    shared = held.groupBy("h1", "h2").agg(F.count("*").alias("holders"), F.max("d").alias("top"), F.sum("n").alias("n")).filter(F.col("holders") >= least_docs)
    shared = cut(shared.select("h1", "h2", "top", "n"), "shared-lines")
    lost = looked_up(hashed, shared, ["h1", "h2"], "n").filter("d <> top")
    positions = lost.groupBy("d", "th").agg(F.collect_set("pos").alias("drop"))  # as many as a text has lines
    whole = rows.join(positions, ["d", "th"], "left")
    number = F.size("lines")
    rest = F.array_except(F.sequence(F.lit(0), number - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(rest, lambda i: F.col("lines")[i]), "\n"))
    return whole.select("doc_id", number.cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"), kept.alias("kept"))


#: The query in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, s.top IS NOT NULL AND s.top <> k.doc_id AS lost FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
