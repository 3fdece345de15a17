"""Quality rules with risk-controlled thresholds. Column expressions only.

Fixed counts per text (`base_counts`) feed four ratios. For each ratio and stratum the lowest cutoff of a
grid is taken whose false rejection is proven limited: with n good labelled documents of which k lie above the
cutoff, the cutoff stands if P(Bin(n, alpha) <= k) <= delta / m, which is to say that the exact
(Clopper-Pearson) upper bound on the share of good documents it rejects is at most alpha. m counts all
strata x ratios x cutoffs (Bonferroni), and alpha is the total risk divided by the number of ratios, so all
the rules of a stratum together reject more than the total risk of its good documents with probability
delta at most over all strata. A ratio without a proven cutoff rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.store import broadcast_if_small, cut

#: Cutoffs tried per ratio; a document is rejected above its cutoff.
GRID = {
    "symbol_ratio": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "dup_line_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75],
    "repeat_ratio": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2],
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0],
}
#: Total share of good documents a stratum may lose to the rules, and the chance that some stratum loses more.
RISK, DELTA = 0.02, 0.05


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed added.

    Null text counts as empty: all counts are 0 and base_failed is true. Everything is computed inside a row, so there is no shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.array_remove(F.split(t, r"[ \t-\r]+"), "")
    with_words = docs.withColumn("_w", w).withColumn("_t", t)
    shifted = [F.slice("_w", k + 1, F.greatest(F.size("_w") - 4, F.lit(0))) for k in range(5)]
    windows = with_words.withColumn("_z", F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])).withColumn(
        "_g", F.transform("_z", lambda s: F.xxhash64(s)))
    # A text without a repeated window, the usual case, is told by a hash set; only the others are sorted.
    entries = F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    )
    twice = windows.withColumn("_e", entries).withColumn("_r", F.array_sort(F.transform(
        F.filter("_e", lambda e, i: e["g"].eqNullSafe(F.get("_e", i - 1)["g"]) | e["g"].eqNullSafe(F.get("_e", i + 1)["g"])),
        lambda e: e["i"])))
    covered = F.aggregate(F.transform("_r", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_r", i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    lines = twice.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0))
    n_words, n_repeat = F.size("_w").cast("long"), F.coalesce(covered, F.lit(0)).cast("long")
    out = lines.select(
        *docs.columns,
        n_words.alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "repeat_ratio": part("n_repeat_words", "n_words"), "word_length": part("word_chars", "n_words")}


def log_factorial(x: Column) -> Column:
    """ln(x!), by Stirling's series of x + 8."""
    z = x.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - F.log((x + 1) * (x + 2.0)) - F.log((x + 3) * (x + 4.0)) - F.log((x + 5) * (x + 6.0)) - F.log((x + 7) * (x + 8.0))


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) from the term of k downwards, in logarithms; from the mean upwards, where no test can pass, 1.

    Below the mean each term is a smaller part of the one before; what lies ten standard deviations and fifty terms below k is less than a part in 10 ** 20 and left out, so
    that a row holds no more than some sqrt(n) terms.
    """
    many = F.least(k, F.ceil(10 * F.sqrt(n * (p * (1 - p)))).cast("long") + 50)
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)

    def step(acc: Column, i: Column) -> Column:
        j = k - i + 1  # from the term of j to that of j - 1
        term = acc["term"] * (j * (1 - p)) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    share = F.when(many < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(many, F.lit(1))), one, step)["total"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(n * math.log1p(-p))).otherwise(F.exp(first + F.log(share)))


def thresholds(counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum and ratio with a proven cutoff: stratum, rule, cutoff, n_good, n_rejected.

    counted: base_counts(documents). labels: doc_id, quality; a document with several labels is good if one of them
    is 1, null qualities and labels of unknown documents are ignored. Documents that fail the base rules are no part of the
    population. A null stratum is a stratum like others. No labels: no row.
    """
    good = labels.select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    scores = F.array(*[F.struct(F.lit(r).alias("rule"), x.alias("score"), F.array(*map(F.lit, GRID[r])).alias("cutoffs")) for r, x in ratios().items()])
    hits = (counted.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
            .select(F.col(stratum).alias("stratum"), F.inline(scores))
            .select("stratum", "rule", "score", F.explode("cutoffs").alias("cutoff"))
            .groupBy("stratum", "rule", "cutoff").agg(F.count("*").alias("n_good"), F.count_if(F.col("score") > F.col("cutoff")).alias("n_rejected")))
    hits = cut(hits, "risk-counts")  # strata x ratios x cutoffs
    m = hits.count() or 1
    proven = binomial_cdf(F.col("n_good"), F.col("n_rejected"), risk / len(GRID)) <= delta / m
    return hits.filter(proven).groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("x")).select("stratum", "rule", "x.*")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Each row of docs (doc_id, text, stratum column) with the base counts, rejected_by (array of ratios) and kept.

    Repeated rows are judged each for itself; an empty table gives an empty result.
    """
    counted = cut(base_counts(docs.select("doc_id", "text", stratum)).drop("text"), "quality-counts")
    cutoffs = cut(thresholds(counted, labels, stratum, risk, delta).groupBy(F.col("stratum").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_c")), "quality-cutoffs")
    joined = counted.join(broadcast_if_small(cutoffs, 50_000), F.col(stratum).eqNullSafe(F.col("_s")), "left")
    rejected = F.array_compact(F.array(*[F.when(x > F.col("_c")[r], F.lit(r)) for r, x in ratios().items()]))
    return joined.withColumn("rejected_by", rejected).drop("_s", "_c").withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


_SQL_RATIOS = {"symbol_ratio": "n_symbols::DOUBLE / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words::DOUBLE / greatest(n_words, 1)", "word_length": "word_chars::DOUBLE / greatest(n_words, 1)"}
_SQL_SCORES = ", ".join(f"{{'rule': '{r}', 'place': {k}, 'score': {x}, 'cutoffs': {GRID[r]}::DOUBLE[]}}" for k, (r, x) in enumerate(_SQL_RATIOS.items()))
#: DuckDB SQL for apply_rules() by lang, with rejected_by joined by commas.
ORACLE = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1))) AS i) u), r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1), l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
b AS (SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w JOIN l ON l.rid = w.rid LEFT JOIN c ON c.rid = w.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b), x AS (SELECT rid, doc_id, lang, base_failed, unnest([{_SQL_SCORES}]) AS s FROM f),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1),
h AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE score > cutoff) AS k FROM (SELECT lang, s.rule AS rule, s.score AS score, unnest(s.cutoffs) AS cutoff FROM x WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)) GROUP BY 1, 2, 3),
q AS (SELECT lang, rule, min(cutoff) AS cutoff FROM h WHERE k < n * {RISK / len(GRID)} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK / len(GRID)}) + (n - j) * ln(1 - {RISK / len(GRID)})))) <= {DELTA} / (SELECT count(*) FROM h) GROUP BY 1, 2),
z AS (SELECT x.rid, string_agg(x.s.rule, ',' ORDER BY x.s.place) AS rejected_by FROM x JOIN q ON q.lang IS NOT DISTINCT FROM x.lang AND q.rule = x.s.rule AND x.s.score > q.cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by FROM f LEFT JOIN z ON z.rid = f.rid
"""
