"""Mixing sources to target weights by pivotal dependent rounding. Column expressions only.

Every document of a source should be taken target / source_size times. The whole part is fixed; the fractions are
rounded dependently: two units i and j trade word mass, which keeps f_i * s_i + f_j * s_j, until one of
the fractions is 0 or 1, and a coin weighted by the two possible trades keeps every document's expectation. Rows that repeat each other are
one unit with a count, whose copies are dealt to the rows evenly.

In a group of documents of one fraction (`_pivot`) the units are a document and all smaller ones of the group, which keep a common fraction, so that
large documents are settled first and at most one, the least as a rule, stays fractional. Groups of about FAN documents, dealt by hash, do this side by side;
what they leave trades one by one (`_trade`) in groups of FAN again, level by level, until one unit per source is left. About RESERVE documents of a source are kept back
for the root: there the last unit trades with all of them and they among themselves, so a source misses its target by about its smallest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.store import broadcast_if_small, cut, tidy

FAN = 64
#: Documents of a source at its root, about.
RESERVE = 1024
ITEM = "struct<h:bigint,doc_id:bigint,size:bigint,f:double,whole:bigint,n:bigint>"


def word_count(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+"), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds weight and target.

    Sources in code-point order, null last, take the weights in turn. Targets share the total by weight but stop at
    cap * source_size; what is over goes to the others by weight. With sources ordered by cap / weight, the level at
    which the first k are full is (total - their caps) / (weights of the others), and its maximum over k is the level reached.
    """
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("limit", "rank")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    full = ranked.withColumn("most", cap * F.col("source_size")).withColumn("limit", F.col("most") / F.col("weight"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything, after = Window.partitionBy(F.lit(0)), by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return full.withColumn("level", level).withColumn("target", F.least("most", F.col("weight") * F.max("level").over(everything))).select("source", "source_size", "weight", "target")


def _coin(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _trade(items: Column, seed: int) -> Column:
    """items, an array of ITEM: (done: array of ITEM with f 0 or 1, carry: the last one)."""
    def step(acc: Column, b: Column) -> Column:
        a = acc["carry"]
        up = F.least((1 - a["f"]) * a["size"], b["f"] * b["size"])  # to a
        down = F.least(a["f"] * a["size"], (1 - b["f"]) * b["size"])  # to b
        rises = _coin(a["h"], b["h"], F.lit(seed)) * (up + down) < down
        a_f = F.when(rises, F.when((1 - a["f"]) * a["size"] <= b["f"] * b["size"], 1.0).otherwise(a["f"] + up / a["size"])).otherwise(
            F.when(a["f"] * a["size"] <= (1 - b["f"]) * b["size"], 0.0).otherwise(a["f"] - down / a["size"]))
        b_f = F.when(rises, F.when(b["f"] * b["size"] <= (1 - a["f"]) * a["size"], 0.0).otherwise(b["f"] - up / b["size"])).otherwise(
            F.when((1 - b["f"]) * b["size"] <= a["f"] * a["size"], 1.0).otherwise(b["f"] + down / b["size"]))
        new_a, new_b = a.withField("f", a_f).cast(ITEM), b.withField("f", b_f).cast(ITEM)
        settled = F.struct(new_a.alias("a"), new_b.alias("b"), ((new_a["f"] <= 0) | (new_a["f"] >= 1)).alias("first"))
        # One-element transform: the trade is worked out once, not once per use.
        return F.transform(F.array(settled), lambda x: F.struct(
            F.concat(acc["done"], F.array(F.when(x["first"], x["a"]).otherwise(x["b"]))).alias("done"), F.when(x["first"], x["b"]).otherwise(x["a"]).alias("carry")))[0]

    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), items[0].cast(ITEM).alias("carry"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _pivot(items: Column, seed: int, lead: Column | None = None) -> Column:
    """Round items, an array of ITEM of one f in descending order of size, and before them the item `lead` of any f: array of ITEM, at most one of them fractional.

    Each item trades with the unit of all after it. The mass that this unit gains or loses is shared out in proportion to size, so its documents keep a common f.
    """
    def step(acc: Column, x: Column, f: Column) -> Column:
        rest = F.when(acc["first"], acc["rest"]).otherwise(F.greatest(acc["rest"] - x["size"], F.lit(0.0)))
        return F.transform(F.array(F.struct(acc["f"].alias("g"), rest.alias("rest"), f.alias("f"), x["size"].cast("double").alias("s"))), lambda u: F.struct(
            u.alias("u"), F.least((1 - u["f"]) * u["s"], u["g"] * u["rest"]).alias("up"), F.least(u["f"] * u["s"], (1 - u["g"]) * u["rest"]).alias("down")))[0]

    def moved(acc: Column, x: Column, f: Column) -> Column:
        def settle(y: Column) -> Column:
            u, up, down = y["u"], y["up"], y["down"]
            rises = _coin(x["h"], F.lit(seed)) * (up + down) < down
            to = F.when(rises, F.when(up >= (1 - u["f"]) * u["s"], 1.0).otherwise(u["f"] + up / u["s"])).otherwise(F.when(down >= u["f"] * u["s"], 0.0).otherwise(u["f"] - down / u["s"]))
            g = (F.when(u["rest"] <= 0, u["g"]).when(rises, F.when(up >= u["g"] * u["rest"], 0.0).otherwise(u["g"] - up / u["rest"]))
                 .otherwise(F.when(down >= (1 - u["g"]) * u["rest"], 1.0).otherwise(u["g"] + down / u["rest"])))
            return F.struct(F.concat(acc["done"], F.array(x.withField("f", to).cast(ITEM))).alias("done"), g.alias("f"), u["rest"].alias("rest"), F.lit(False).alias("first"))

        return F.transform(F.array(step(acc, x, f)), settle)[0]

    total = F.aggregate(items, F.lit(0.0), lambda t, x: t + x["size"])
    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), F.coalesce(F.get(items, F.lit(0))["f"], F.lit(0.0)).alias("f"), total.alias("rest"), F.lit(False).alias("first"))
    if lead is not None:  # the lead is no part of the total
        start = F.when(lead.isNull(), start).otherwise(moved(start.withField("first", F.lit(True)), lead, lead["f"]))
    return F.aggregate(items, start, lambda acc, x: moved(acc, x, acc["f"]))["done"]


def row_hash(docs: DataFrame) -> Column:
    """64 bits of a whole row; maps, which have no order, are left out."""
    return F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t])


def copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, fan: int = FAN, reserve: int = RESERVE) -> DataFrame:
    """One row per row of docs (doc_id, text, source): h, doc_id, size, source_size, target, copies (0 to cap).

    h hashes the whole row, so repeated rows share it; their copies differ by one at most. size is the number of words
    `[^\\x20\\x09-\\x0D]+`, 0 for null text. Documents without words weigh nothing; their copies are rounded alone. Null
    sources are a source. Nothing depends on the order or partitioning of docs, so reruns agree. Empty docs: no rows.
    """
    units = unit_copies(docs, weights, cap, seed, fan, reserve)
    # Of n equal rows the first total % n have one copy more than the others; rows are unfolded in two steps, so that no array is longer than UNFOLD.
    blocks = units.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / UNFOLD))))
    rows = blocks.withColumn("r", F.explode(F.sequence(F.col("k") * UNFOLD, F.least(F.col("n"), (F.col("k") + 1) * UNFOLD) - 1)))
    each = F.floor(F.col("total") / F.col("n")) + F.when(F.col("r") < F.col("total") % F.col("n"), 1).otherwise(0)
    return rows.select("h", "doc_id", "size", "source_size", "target", each.cast("long").alias("copies"))


#: Rows that one row is unfolded to at once.
UNFOLD = 4096


def unit_copies(docs: DataFrame, weights: tuple[float, ...], cap: float, seed: int, fan: int = FAN, reserve: int = RESERVE) -> DataFrame:
    """One row per different row of docs: h, doc_id, size, n (rows like it), total (copies of all of them), source_size, target."""
    tidy(docs.sparkSession)
    sized = docs.select(row_hash(docs).alias("h"), "doc_id", "source", word_count("text").alias("size"))
    sized = cut(sized.groupBy("h", "doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    plan = targets(per.select("source", "source_size"), weights, cap).select(F.col("source").alias("_s"), "source_size", "target", F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("sid"))
    plan = cut(plan.join(per.select(F.col("source").alias("_p"), "units"), F.col("_s").eqNullSafe(F.col("_p"))).drop("_p"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.greatest(F.ceil(F.col("units") / fan), F.lit(1))
    wanted = F.col("n") * rate
    items = (sized.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_s")))
             .withColumn("whole", F.floor(wanted)).withColumn("f", wanted - F.col("whole")).withColumn("g", F.pmod(F.xxhash64("h", F.lit(seed)), groups))
             .withColumn("back", (F.col("n") == 1) & (F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.col("units")) < reserve)))
    open_ = (F.col("f") > 0) & (F.col("size") > 0)
    alone = F.col("whole") + F.when(_coin(F.col("h"), F.lit(seed)) < F.col("f"), 1).otherwise(0)
    out = [items.filter(~open_).select("sid", "h", "doc_id", "size", "n", alone.alias("total"))]
    item = F.struct("h", "doc_id", "size", F.col("f").cast("double").alias("f"), F.col("whole").cast("long").alias("whole"), "n").cast(ITEM)
    left = items.filter(open_).select("sid", "g", "n", "back", item.alias("item"))
    total = lambda x: x.select("sid", F.col("item.h").alias("h"), F.col("item.doc_id").alias("doc_id"), F.col("item.size").alias("size"), F.col("item.n").alias("n"), (F.col("item.whole") + F.col("item.f").cast("long")).alias("total"))
    settled, open_item = (F.col("item.f") <= 0) | (F.col("item.f") >= 1), (F.col("item.f") > 0) & (F.col("item.f") < 1)
    by_size = F.sort_array(F.collect_list(F.struct(F.col("item.size").alias("size"), "item")), asc=False)["item"]

    # Single documents of a source share one fraction; units of several rows have their own.
    first = left.filter("n = 1 and not back").groupBy("sid", "g").agg(by_size.alias("items")).select("sid", "g", F.explode(_pivot(F.col("items"), seed)).alias("item"))
    level = cut(first, "mix-level")
    out.append(total(level.filter(settled)))
    carried = level.filter(open_item).unionByName(left.filter("n > 1").select("sid", "g", "item"))
    most = plan.agg(F.max(groups)).first()[0] or 1
    while True:  # log_fan(documents) levels
        dealt = carried.groupBy("sid", "g").agg(F.sort_array(F.collect_list("item")).alias("items"))
        traded = dealt.select("sid", "g", _trade(F.col("items"), seed).alias("r")).select("sid", "g", F.explode(F.concat(F.col("r.done"), F.array(F.col("r.carry").cast(ITEM)))).alias("item"))
        level = cut(traded, "mix-level")
        out.append(total(level.filter(settled)))
        carried = level.filter(open_item).select("sid", F.floor(F.col("g") / fan).alias("g"), "item")
        if most == 1:
            break
        most = -(-most // fan)
    kept = left.filter("back").groupBy("sid").agg(by_size.alias("items"))
    root = kept.join(carried.select("sid", F.col("item").alias("lead")), "sid", "full").withColumn("items", F.coalesce("items", F.array().cast(f"array<{ITEM}>")))
    end = cut(root.select("sid", F.explode(_pivot(F.col("items"), seed, F.col("lead"))).alias("item")), "mix-root")
    out.append(total(end.filter(settled)))
    out.append(total(end.filter(open_item).withColumn("item", F.col("item").withField("f", F.when(_coin(F.col("item.h"), F.lit(seed + 2)) < F.col("item.f"), 1.0).otherwise(0.0)))))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.join(broadcast_if_small(plan.select("sid", "source_size", "target")), "sid").drop("sid")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, whatever their names. Rows that repeat each other come as often as all of them are taken."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_hash(docs).alias("h"), "doc_id").dropDuplicates(["h", "doc_id"])
    n = unit_copies(docs, weights, cap, seed).select("h", F.col("doc_id").alias("d"), "total").filter("total > 0")
    taken = keyed.join(n, (keyed["h"] == n["h"]) & keyed["doc_id"].eqNullSafe(n["d"])).select("row", "total")
    blocks = taken.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / UNFOLD))))
    return blocks.select("row", F.explode(F.sequence(F.col("k") * UNFOLD, F.least(F.col("total"), (F.col("k") + 1) * UNFOLD) - 1)).alias("r")).select("row.*")
