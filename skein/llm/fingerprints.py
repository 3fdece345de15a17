"""Document fingerprints by consistent weighted sampling. Column expressions only.

A text is its words with their counts as weights. Sample i draws for each word, from hashes of the word and i, r and c of Gamma(2, 1)
and b of Uniform(0, 1), and rounds the weight w down to a point of the word's own grid: t = floor(ln w / r + b). The word with
the least ln a = ln c - r * (t - b) - r is the sample, together with its t. Two texts draw the same sample with a probability of
sum of min / sum of max of their weights, the generalised Jaccard similarity, so the share of equal samples estimates it.

A sample is computed as one number, ln a in the upper and a code of (word, t) in the lower bits, so that a minimum over numbers
is all the aggregation there is. Texts are shuffled once, dealt by ranges of BUCKET ids; a range's words, weights, samples and
neighbours are then worked out where its texts lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.store import broadcast_if_small, cut

SAMPLES = 32
#: Ids in a range, and texts to a partition.
BUCKET, PART = 128, 1200
CODE_BITS, SCALE_BITS = 26, 29  # the sum of both and of 7.1 bits for ln a + 128 stays under 63


def _uniform(h: Column, k: int) -> Column:
    """The k-th (0 to 2) 21 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)


def sample(word: Column, log_weight: Column, i: int) -> Column:
    """The number whose minimum over a text's words is its i-th sample. word: 64-bit hash."""
    one, two = F.xxhash64(word, F.lit(2 * i)), F.xxhash64(word, F.lit(2 * i + 1))
    r = -F.log(_uniform(one, 0) * _uniform(one, 1))
    log_c = F.log(-F.log(_uniform(two, 0) * _uniform(two, 1)))
    b = _uniform(one, 2)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r  # from -70 to 4 for any weight below 2 ** 40
    code = (F.shiftrightunsigned(two, 38) + t * 40503).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    return F.shiftleft(F.floor((log_a + 128) * float(1 << SCALE_BITS)), CODE_BITS).bitwiseOR(code)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, such a one and another are not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same).cast("double")


def spelled(samples: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits a sample, nothing for a text without words."""
    return F.lower(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _sampled(texts: DataFrame, keys: list[str], text: str, samples: int) -> DataFrame:
    """keys and samples (array<int>) of each row of texts, which is dealt by a subset of keys; rows without words have none."""
    words = texts.select(*keys, F.explode(F.array_remove(F.split(text, r"[ \t-\r]+"), "")).alias("w")).select(*keys, F.xxhash64("w").alias("w"))
    weights = words.groupBy(*keys, "w").agg(F.count("*").alias("n")).withColumn("n", F.log("n"))
    least = weights.groupBy(*keys).agg(*[F.min(sample(F.col("w"), F.col("n"), i)).alias(f"m{i}") for i in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"m{i}").bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("int") for i in range(samples)]).alias("samples"))


def _next_above(ranges: DataFrame) -> DataFrame:
    """ranges (bucket, ...) with `to`: the next higher bucket, the lowest one for the highest. Buckets are looked at in blocks of 4096, blocks by their ends."""
    block = F.floor(F.col("bucket") / 4096)
    ends = ranges.groupBy(block.alias("block")).agg(F.min("bucket").alias("least"))
    after = ends.select("block", F.coalesce(F.lead("least").over(Window.orderBy("block")), F.min("least").over(Window.partitionBy())).alias("beyond"))  # a row a block
    inside = ranges.withColumn("block", block).withColumn("to", F.lead("bucket").over(Window.partitionBy("block").orderBy("bucket")))
    return inside.join(after, "block").withColumn("to", F.coalesce("to", "beyond")).drop("block", "beyond")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text is empty. Rows are in descending order of doc_id, null last, and rows of one doc_id in order of text; after the last
    comes the first. The edited text is the text without its last floor(n_chars / 3) code points, and as many of the first of the next
    row's (or all). near_*: likeness of a row's samples to those of its edited text and of the next row.
    """
    bucket = F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.lit(-(1 << 62)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket)
    # A range's first row follows the last one of the range above, the highest range's the last one of the lowest.
    ranges = cut(docs.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")), "ranges")
    n = ranges.agg(F.sum("n")).first()[0] or 0
    heads = cut(_next_above(ranges).select("bucket", F.col("top").alias("_top"), "to"), "range-heads")
    firsts = (rows.join(broadcast_if_small(heads.select(F.col("bucket").alias("_b"), "_top", "to")), F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("bucket") == F.col("_b")))
              .groupBy(F.col("to").alias("bucket")).agg(F.min("text").alias("beyond")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n // PART, 200_000))
    inside = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    placed = rows.repartition(parts, "bucket").withColumn("pos", F.row_number().over(inside)).withColumn("next", F.lead("text").over(inside))
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    whole = (placed.join(firsts, "bucket", "left").withColumn("next", F.coalesce("next", "beyond"))
             .select("bucket", "pos", "doc_id", chars.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), chars - third), F.substring("next", F.lit(1), third)).alias("edited")))
    sides = whole.select("bucket", "pos", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x")).select("bucket", "pos", "x.*")
    drawn = _sampled(sides, ["bucket", "pos", "side"], "t", samples).groupBy("bucket", "pos").agg(*[F.max(F.when(F.col("side") == s, F.col("samples"))).alias(name) for s, name in enumerate(("own", "changed"))])
    about = whole.select("bucket", "pos", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    nothing = F.array().cast("array<int>")
    table = cut(about.join(drawn, ["bucket", "pos"], "left").withColumn("own", F.coalesce("own", nothing)).withColumn("changed", F.coalesce("changed", nothing)), "samples")
    follows = Window.partitionBy("bucket").orderBy("pos")
    first_samples = table.filter("pos = 1").join(broadcast_if_small(heads.select("bucket", "to")), "bucket").select(F.col("to").alias("bucket"), F.col("own").alias("beyond"))
    chained = table.withColumn("after", F.lead("own").over(follows)).join(first_samples, "bucket", "left").withColumn("after", F.coalesce("after", "beyond"))
    return chained.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("changed")).alias("edited_fingerprint"),
                          likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
