import math
import re

from pyspark.sql import functions as F

from skein.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    rep = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)


TEXTS = [None, "", " \t\r\n", "a", "a b c d e a b c d e f", "x " * 30, "one\none\n\n two\none \none", "é$ ü#|<>   z", "a b c d e f g a b c d e q a b c d e", "w%d " * 12 + "\n" + "long" * 900]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + [(1, "", "en")], "doc_id long, text string, lang string")
    for r in Q.base_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r


def test_binomial(spark):
    cases = [(n, k) for n in (1, 5, 40, 300) for k in (0, 1, 2, 7, 20) if k < n * 0.1]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", Q.binomial_cdf(F.col("n"), F.col("k"), 0.1).alias("p")).collect()
    for r in rows:
        want = sum(math.comb(r.n, j) * 0.1**j * 0.9 ** (r.n - j) for j in range(r.k + 1))
        assert abs(r.p - want) < 1e-9


def test_thresholds_limit_false_rejection(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("alpha beta gamma delta "), 1), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 7 + k).cast("string")) for k in range(30)]), F.when(F.col("id") % 4 == 0, F.repeat(F.lit(" #$%"), 40)).otherwise("")).alias("text"), F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    out = Q.apply_rules(docs, labels, risk=0.05).collect()
    assert all(not r.kept for r in out if r.doc_id % 4 == 0)
    assert all(r.kept for r in out if r.doc_id % 4)
    none = Q.apply_rules(docs.limit(0), labels.limit(0)).collect()
    assert none == []
    unlabelled = Q.apply_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in unlabelled) and len(unlabelled) == 4000


def test_binomial_of_many(spark):
    n, p = 2_000_000, 0.005
    for k in (9_300, 9_700, 9_990):
        top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        term = total = 1.0
        for j in range(k, max(0, k - 20_000), -1):
            term *= j * (1 - p) / ((n - j + 1) * p)
            total += term
        got = spark.range(1).select(Q.binomial_cdf(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("p")).first().p
        assert abs(got / (math.exp(top) * total) - 1) < 1e-5


def test_cutoffs_against_brute_force(spark):
    import random

    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["alpha", "be#ta", "g&", "delta%|", "epsilon"]) + str(r.randrange(r.choice([3, 4000]))) for _ in range(r.randrange(8, 60))), r.choice(["en", "fr", None])) for i in range(900)]
    labels = [(i, int(r.random() < 0.8)) for i, _, _ in rows if i % 5]
    counted = Q.base_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).withColumns({k: v for k, v in Q.ratios().items()}).collect()
    good = {i for i, q in labels if q}
    m = len({c.lang for c in counted if c.doc_id in good and not c.base_failed}) * sum(map(len, Q.GRID.values()))
    want = {}
    for lang in {c.lang for c in counted}:
        for rule, grid in Q.GRID.items():
            scores = [c[rule] for c in counted if c.lang == lang and c.doc_id in good and not c.base_failed]
            n, alpha = len(scores), 0.4 / len(Q.GRID)
            for cutoff in grid:
                k = sum(s > cutoff for s in scores)
                if k < n * alpha and sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) <= 0.2 / m:
                    want[lang, rule] = cutoff
                    break
    out = Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.4, delta=0.2).collect()
    assert want
    for c, o in zip(sorted(counted, key=lambda x: x.doc_id), sorted(out, key=lambda x: x.doc_id), strict=True):
        hit = [rule for rule in Q.GRID if (c.lang, rule) in want and c[rule] > want[c.lang, rule]]
        assert sorted(o.rejected_by) == sorted(hit) and o.kept == (not c.base_failed and not hit)
