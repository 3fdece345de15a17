"""Counts, ratios, histograms and evaluations over a corpus."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import dot


def with_total(rows: DataFrame, group: str, value: Column | None = None, name: str = "n") -> DataFrame:
    """group, n, total: rows (or the sum of a value) per group and of all groups up to it. Groups are few, as levels or months are."""
    n = rows.groupBy(group).agg((F.count("*") if value is None else F.sum(value)).alias(name))
    return n.withColumn("total", F.sum(name).over(Window.orderBy(group)))


def dense_months(months: DataFrame) -> DataFrame:
    """month, n, upto: papers of each month (month: index) from 0 to the last one, empty months included, and those up to it."""
    n = months.groupBy("month").agg(F.count("*").alias("n"))
    dense = n.agg(F.max("month").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(0), "m")).alias("month"))
    return dense.join(n, "month", "left").na.fill(0, ["n"]).withColumn("upto", F.sum("n").over(Window.orderBy("month")))


#: Months that a bar may stand for, and the most bars of a histogram.
BAR_MONTHS, MOST_BARS = (1, 3, 6, 12, 24, 60), 56


def bars(months: DataFrame, first: int, last: int) -> DataFrame:
    """bar, n, inside: papers (month: index) in bars of the least number of months that gives at most MOST_BARS, the longest if none does; inside counts months first..last."""
    m = months.groupBy("month").agg(F.count("*").alias("n"))
    step = F.coalesce(*[F.when(F.ceil(F.col("months") / s) <= MOST_BARS, s) for s in BAR_MONTHS], F.lit(BAR_MONTHS[-1]))
    each = m.crossJoin(F.broadcast(m.agg((F.max("month") + 1).alias("months"))))  # one row
    return each.groupBy(F.floor(F.col("month") / step).alias("bar")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("month").between(first, last), F.col("n")).otherwise(0)).alias("inside"))


def log_steps(papers: DataFrame, steps: int = 48) -> DataFrame:
    """step, cited: counts at even steps of log(1 + cited) from 0 to the greatest."""
    top = papers.agg(F.log1p(F.coalesce(F.max("cited"), F.lit(0))).alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "top").select("step", F.round(F.expm1(F.col("step") / steps * F.col("top"))).cast("bigint").alias("cited"))


def level_stats(papers: DataFrame) -> DataFrame:
    """level, n, least, middle, upto: number, least and median count of papers (level, cited), and papers up to the level.

    The median is taken from the counts of different values, so no buffer holds a level's papers.
    """
    values = papers.groupBy("level", "cited").agg(F.count("*").alias("c"))
    upto = values.withColumn("hi", F.sum("c").over(Window.partitionBy("level").orderBy("cited"))).withColumn("n", F.sum("c").over(Window.partitionBy("level")))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = lambda k: (k < F.col("hi")) & (k >= F.col("hi") - F.col("c"))
    g = upto.groupBy("level").agg(F.max("n").alias("n"), F.min("cited").alias("least"), ((F.max(F.when(at(lo), F.col("cited"))) + F.max(F.when(at(hi), F.col("cited")))) / 2).cast("double").alias("middle"))
    return g.withColumn("upto", F.sum("n").over(Window.orderBy("level")))


def topic_tree(papers: DataFrame, levels: list[str]) -> DataFrame:
    """The levels' columns, n, level: papers of each value of the first level, of each pair of the first two, and so on; empty ones have no row. level counts what is folded."""
    sets = [levels[: k + 1] for k in range(len(levels))]
    return papers.groupingSets(sets, *levels).agg(F.count("*").alias("n"), (sum((F.grouping(c).cast("int") for c in levels[1:]), F.lit(0))).alias("level"))


def coverage(rows: DataFrame, shares: dict[str, Column]) -> DataFrame:
    """One row: for each name, the share of rows for which a condition holds (null: it does not), to six digits; null without rows."""
    return rows.agg(*[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(n) for n, c in shares.items()])


def census(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, and n; of equal ones the lesser first."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, majority: the most frequent value, the least of equal ones."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v")))["v"].alias("majority"))


def importance(papers: DataFrame, now: float, power: float = 0.5) -> DataFrame:
    """node, importance: cited / age ** power of papers (node, cited, year); age is at least half a year, and that of the median year where the year is missing."""
    years = papers.filter("year is not null").groupBy("year").agg(F.count("*").alias("c"))
    upto = years.withColumn("hi", F.sum("c").over(Window.orderBy("year"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda k: F.max(F.when((k < F.col("hi")) & (k >= F.col("hi") - F.col("c")), F.col("year")))
    middle = upto.agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("m"))
    age = F.greatest(F.lit(now) - (F.coalesce("year", "m") + 0.5), F.lit(0.5))
    return papers.crossJoin(F.broadcast(middle)).select("node", F.round(F.col("cited") / F.pow(age, F.lit(power)), 4).alias("importance"))  # one row


def cohorts(papers: DataFrame, by: list[str], share: float) -> DataFrame:
    """by, n, mean, ratio, share: number and mean count of papers (cited, refs), sum of refs over sum of cited, and the share with cited >= share."""
    return papers.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("cited"), 4).alias("mean"), F.round(F.sum("refs") / F.sum("cited"), 4).alias("ratio"), F.round(F.avg((F.col("cited") >= share).cast("int")), 4).alias("share"))


def threshold_scan(scores: DataFrame, first: int, last: int, per_unit: int) -> DataFrame:
    """t, caught, wrong: for thresholds first / per_unit .. last / per_unit, how many scores (label 0 or 1, score) of label 1 and of label 0 reach it.

    Each score is counted at the highest threshold that it reaches; running sums from above give the rest.
    """
    n = F.floor(F.col("score") * per_unit + 1e-6)
    reached = F.when(n / per_unit <= F.col("score"), n).otherwise(n - 1)
    s = scores.select("label", reached.alias("n")).filter(F.col("n") >= first).groupBy(F.least("n", F.lit(last)).alias("n")).agg(F.count_if(F.col("label") == 1).alias("c"), F.count_if(F.col("label") == 0).alias("w"))
    grid = scores.sparkSession.range(first, last + 1).withColumnRenamed("id", "n").join(s, "n", "left").na.fill(0)
    above = Window.orderBy(F.desc("n"))
    return grid.select(F.round(F.col("n") / per_unit, 3).alias("t"), F.sum("c").over(above).alias("caught"), F.sum("w").over(above).alias("wrong"))


def best_threshold(scan: DataFrame) -> DataFrame:
    """The row of threshold_scan with the most caught less wrong ones, the lowest of equals."""
    return scan.orderBy(F.desc(F.col("caught") - F.col("wrong")), "t").limit(1)


def _above(queries: pa.Table, vectors: pa.Table) -> pa.Table:
    """node, n: of a block of queries (q, qv, gold) and one of vectors (node, v), how many others' scores, to five digits, are above a query's gold."""
    from skein.operators.vectors import AT_ONCE, matrix

    q, gold, ns = queries["q"].combine_chunks(), queries["gold"].to_numpy(), vectors["node"].to_numpy()
    n = np.zeros(len(q), np.int64)
    if len(q) and len(ns):
        ids, x, y = q.to_numpy(), matrix(queries["qv"].combine_chunks()), matrix(vectors["v"].combine_chunks())
        for lo in range(0, len(q), AT_ONCE):
            some = slice(lo, lo + AT_ONCE)
            s, half = x[some] @ y.T, gold[some, None] + 0.5e-5
            slack = 1e-9 * (1 + np.abs(half))
            able = (ids[some, None] != ns[None]) & ~np.isnan(half)
            over = able & ~(s < half + slack)
            i, j = np.nonzero(able & (np.abs(s - half) <= slack))  # too near for a matrix product's last digits: added in order, rounded in decimals
            over[i, j] = [Decimal(repr(float(np.cumsum(x[lo + a] * y[b])[-1]))).quantize(Decimal("0.00001"), ROUND_HALF_UP) > Decimal(repr(float(gold[lo + a]))) for a, b in zip(i, j, strict=True)]
            n[some] = over.sum(1)
    return pa.Table.from_arrays([q, pa.array(n)], names=["node", "n"])


def gold_ranks(queries: DataFrame, vectors: DataFrame, blocks: int | None = None) -> DataFrame:
    """node, rank: where the right answer of each query (node, q, g: its right answer's vector) stands among all vectors (node, v) but itself, 1 being the nearest.

    Queries meet the vectors block by block, a matrix product each, and only counts leave a block.
    """
    from skein.operators.vectors import met

    gold = queries.select("node", "q", F.round(dot(F.col("q"), F.col("g")), 5).alias("gold"))
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())  # no score with others, nor to them
    q, v = met(gold.filter("gold is not null").select(F.col("node").alias("q"), F.col("q").alias("qv"), "gold", F.lit(0).alias("w")), vectors.filter(whole).select("node", "v", F.lit(0).alias("w")), blocks)
    n = q.cogroup(v).applyInArrow(_above, f"node {dict(queries.dtypes)['node']}, n bigint")
    return gold.select("node", F.lit(0).cast("bigint").alias("n")).unionByName(n).groupBy("node").agg((F.sum("n") + 1).alias("rank"))


def recall_at(ranks: DataFrame, at: list[int]) -> DataFrame:
    """One row: recall_<k>, the share of ranks up to k, for each k."""
    return ranks.agg(*[F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"recall_{k}") for k in at])


def carry_over(rows: DataFrame, held: Column, gaps: list[int]) -> DataFrame:
    """gap, scored, predicted, tp, fp, fn: how well the value of an author's paper nearest in time, at most `gap` days away, foretells that of the held-out papers.

    rows: key, node, day, value. A paper without a near one is scored as not foretold.
    """
    from skein.operators.lookups import nearest_in_time

    tested = rows.filter(held)
    near = nearest_in_time(tested, rows, "value").select("key", "node", "gap", F.col("value").alias("pred"))
    each = tested.select("key", "node", F.col("value").alias("truth")).join(near.withColumnRenamed("gap", "away"), ["key", "node"], "left").withColumn("gap", F.explode(F.array(*map(F.lit, gaps))))
    p = each.withColumn("pred", F.when(F.col("away") <= F.col("gap"), F.col("pred")))
    return p.groupBy("gap").agg(F.count("*").alias("scored"), F.count("pred").alias("predicted"), F.count_if(F.col("pred") == F.col("truth")).alias("tp"), F.count_if(F.col("pred") != F.col("truth")).alias("fp"), F.count_if(~F.col("pred").eqNullSafe(F.col("truth"))).alias("fn"))


def region_leaves(cells: DataFrame) -> DataFrame:
    """node, cell: the deepest cell (node, level, cell) that holds a node, the least of one level."""
    return cells.groupBy("node").agg(F.min(F.struct((-F.col("level")).alias("l"), "cell"))["cell"].alias("cell"))


def hold_out(rows: DataFrame, key: str, per_mille: int) -> DataFrame:
    """A fixed sample of rows by a multiplicative hash of their key."""
    return rows.filter(F.pmod(F.pmod(F.col(key), F.lit(1000)) * (2654435761 % 1000), F.lit(1000)) < per_mille)  # reduced first, so that no key is too large


def exact_quantiles(rows: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Some quantiles of a column as numbers, as by exact_quantile, from one numbering of its values."""
    from skein.operators.corpus import dense_id

    each = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"), F.monotonically_increasing_id().alias("_u"))
    placed = dense_id(each, ["_x", "_u"], "_i")
    n = placed.count()
    if not n:
        return [None] * len(qs)
    at = [(n - 1) * q for q in qs]
    wanted = sorted({k for x in at for k in (int(x), min(int(x) + 1, n - 1))})
    found = {r["_i"]: r["_x"] for r in placed.filter(F.col("_i").isin(wanted)).collect()}  # two rows a quantile
    return [found[int(x)] + (found[min(int(x) + 1, n - 1)] - found[int(x)]) * (x - int(x)) for x in at]


def exact_quantile(rows: DataFrame, column: str, q: float) -> DataFrame:
    """One row, q: the quantile of a column between its two next values, as by linear interpolation; null without values.

    Places come from a range partition (dense_id), so no task holds all values.
    """
    from skein.operators.corpus import dense_id

    each = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"), F.monotonically_increasing_id().alias("_u"))
    placed = dense_id(each, ["_x", "_u"], "_i")
    at = placed.agg(((F.count("*") - 1) * q).alias("at"))
    near = placed.crossJoin(F.broadcast(at)).filter((F.col("_i") == F.floor("at")) | (F.col("_i") == F.ceil("at")))  # one row
    lo, hi = F.min_by("_x", "_i"), F.max_by("_x", "_i")
    return near.agg((lo + (hi - lo) * (F.max("at") - F.floor(F.max("at")))).alias("q"))


def summary(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """group, lo, the named quantiles, hi, to four digits. Quantiles lie between the two next values; they come from the counts of different values."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    upto = n.withColumn("_hi", F.sum("_c").over(Window.partitionBy(group).orderBy("_x"))).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))

    def between(q: float) -> Column:
        at = (F.col("_n") - 1) * q
        pick = lambda k: F.max(F.when((k < F.col("_hi")) & (k >= F.col("_hi") - F.col("_c")), F.col("_x")))
        lo, hi, part = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
        return F.round(lo + (hi - lo) * part, 4)

    return upto.groupBy(group).agg(F.round(F.min("_x"), 4).alias("lo"), *[between(q).alias(k) for k, q in quantiles.items()], F.round(F.max("_x"), 4).alias("hi"))
