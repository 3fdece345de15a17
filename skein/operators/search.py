"""Token search over titles: inverted index, chunks, ranked lookup, set labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import search_tokens


def postings(docs: DataFrame, most: int) -> DataFrame:
    """docs: node, title, cited. token, node, cited, capped: a token of more than `most` titles keeps the most-cited (then least node)."""
    each = docs.select("node", "cited", F.explode(search_tokens(F.col("title"))).alias("token"))
    size = each.groupBy("token").agg(F.count("*").alias("n"))
    small = each.join(size.filter(F.col("n") <= most).select("token"), "token").select("token", "node", "cited", F.lit(False).alias("capped"))
    ranked = each.join(size.filter(F.col("n") > most).select("token"), "token").withColumn("salt", F.pmod(F.hash("node"), F.lit(32)))
    order = [F.desc("cited"), F.col("node")]
    # A frequent token's rows are ranked in 32 parts first, so that its task sees 32 * most rows at most.
    part = ranked.withColumn("k", F.row_number().over(Window.partitionBy("token", "salt").orderBy(*order))).filter(F.col("k") <= most)
    top = part.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy(*order))).filter(F.col("k") <= most).select("token", "node", "cited", F.lit(True).alias("capped"))
    return small.unionByName(top)


def chunks(tokens: DataFrame, count: int) -> DataFrame:
    """chunk, first, last, tokens of the alphabet cut into `count` chunks of equally many tokens."""
    from skein.operators.corpus import dense_id

    t = dense_id(tokens.select("token").distinct(), ["token"], "i")
    per = F.greatest(F.ceil(F.lit(t.count()) / count), F.lit(1))
    return t.groupBy(F.floor(F.col("i") / per).alias("chunk")).agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count("*").alias("tokens"))


def title_search(index: DataFrame, query: str, limit: int, prefix_tokens: int = 64, fetches: int = 4) -> DataFrame:
    """node, exact, sampled, cited of the titles that match, best first.

    The longest words are looked up; the last one also as a prefix, of up to prefix_tokens tokens. A word whose lists are complete must match, a
    word with a capped list only adds to the rank. If a complete word has no title, nothing matches; if all words are capped, titles that have
    them all, or else the first word.
    """
    spark = index.sparkSession
    words = list(dict.fromkeys(w for w in _words(query) if len(w) >= 2))
    if not words:
        return index.select("node", F.lit(0).alias("exact"), F.lit(0).alias("sampled"), "cited").limit(0)
    last = words[-1]
    used = sorted(words, key=lambda w: -len(w))[:fetches]
    w = spark.createDataFrame([(x, x == last) for x in used], "word string, prefix boolean")
    same = F.col("token") == F.col("word")
    # The query's own words narrow the index down first, by equality and one range, which its chunks and files are pruned by.
    wanted = F.col("token").isin(used)
    if last in used:
        wanted = wanted | (F.col("token") >= last) & (F.col("token") < last[:-1] + chr(ord(last[-1]) + 1))
    hit = index.filter(wanted).join(F.broadcast(w), same | F.col("prefix") & F.col("token").startswith(F.col("word")))  # a few words
    near = hit.filter(~same).select("word", "token").distinct().withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("token"))).filter(F.col("k") < prefix_tokens).select("word", "token")
    hits = hit.filter(same).withColumn("same", F.lit(1)).unionByName(hit.join(near, ["word", "token"], "left_semi").filter(~same).withColumn("same", F.lit(0)))
    per = hits.groupBy("word", "node").agg(F.max("cited").alias("cited"), F.max("same").alias("same"))
    state = w.join(hits.groupBy("word").agg(F.bool_or("capped").alias("capped")), "word", "left").select("word", F.coalesce("capped", F.lit(False)).alias("capped"))
    flat = state.agg(F.count_if(~F.col("capped")).alias("complete"), F.count("*").alias("words"))
    found = per.join(F.broadcast(state), "word").groupBy("node").agg(F.max("cited").alias("cited"), F.sum("same").alias("exact"), F.count_if("capped").alias("sampled"), F.count_if(~F.col("capped")).alias("met"), F.count("*").alias("all_met"), F.max(F.when(F.col("word") == words[0], 1).otherwise(0)).alias("first"))
    kept = found.crossJoin(F.broadcast(flat)).filter(F.col("met") == F.col("complete"))  # one row
    full = kept.agg(F.coalesce(F.max((F.col("all_met") == F.col("words")).cast("int")), F.lit(0)).alias("full"))
    chosen = kept.crossJoin(F.broadcast(full)).filter((F.col("complete") > 0) | (F.col("full") == 1) & (F.col("all_met") == F.col("words")) | (F.col("full") == 0) & (F.col("first") == 1))
    return chosen.select("node", F.col("exact").cast("int").alias("exact"), F.col("sampled").cast("int").alias("sampled"), "cited").orderBy(F.desc("exact"), F.desc("sampled"), F.desc("cited"), "node").limit(limit)


def _words(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def set_label_terms(docs: DataFrame, stop: list[str], k: int, most_chars: int | None = None) -> DataFrame:
    """docs: set, node, title. set, term, tf, df, score: the k one- and two-word terms of each set of titles that tell it from the other sets.

    Score: share of the set's terms times ln(1 + sets / (1 + sets that have it)). Terms occur twice at least in sets of more than four titles.
    """
    text = F.lower("title") if most_chars is None else F.substring(F.lower("title"), 1, most_chars)
    words = F.filter(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~x.isin(*stop))
    w = docs.withColumn("w", words)
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    terms = w.select("set", F.explode(F.concat("w", pairs)).alias("term")).groupBy("set", "term").agg(F.count("*").alias("tf"))
    size = docs.groupBy("set").agg(F.count("*").alias("titles"))
    n = size.count()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    all_ = terms.groupBy("set").agg(F.sum("tf").alias("total"))
    scored = terms.join(df, "term").join(all_, "set").join(size, "set").filter((F.col("tf") >= 2) | (F.col("titles") <= 4)).withColumn("score", F.round(F.col("tf") / F.col("total") * F.log(1 + n / (1 + F.col("df"))), 6))
    return scored.withColumn("k", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("score"), "term"))).filter(F.col("k") <= k).select("set", "term", "tf", "df", "score")
