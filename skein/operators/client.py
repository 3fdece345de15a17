"""What an interactive map asks of a corpus: lists, culls, levels of detail, comparisons, label choice on the screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Orders of a result list: by citations, newest first, oldest first; citations decide within a year.
ORDERS = {"cited": ("-cited", "node"), "newest": ("-year", "-cited", "node"), "oldest": ("year", "-cited", "node")}


def _order(names: tuple[str, ...]) -> list[Column]:
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def result_list(papers: DataFrame, match: Column | None = None, order: str = "cited", most: int = 500) -> DataFrame:
    """The first `most` of the papers that match, in one of ORDERS."""
    return (papers if match is None else papers.filter(match)).orderBy(*_order(ORDERS[order])).limit(most)


def shared_papers(a: DataFrame, b: DataFrame, papers: DataFrame, most: int = 50) -> DataFrame:
    """The most cited papers (node, cited, ...) of both sets (node)."""
    return result_list(papers.join(a.select("node").distinct(), "node", "left_semi").join(b.select("node").distinct(), "node", "left_semi"), most=most)


def figure_queue(papers: DataFrame, most: int) -> DataFrame:
    """The most cited papers that have an arXiv id."""
    return result_list(papers, F.coalesce("arxiv_id", F.lit("")) != "", most=most)


def label_priority(groups: DataFrame, bands: int) -> DataFrame:
    """groups (band, n, ...) with priority: a thousand for each band below, and n as a share of the band's largest in percent, to two digits."""
    return groups.withColumn("priority", F.round((bands - F.col("band")) * 1000 + F.col("n") * 100 / F.max("n").over(Window.partitionBy("band")), 2))


def visible_count(zoom: Column, base: int = 2000, growth: float = 4.0, most: int = 1_000_000) -> Column:
    """Points shown at a zoom: `base` at 0, `growth` times as many every two steps."""
    return F.least(F.lit(most), F.round(base * F.pow(F.lit(growth), zoom / 2))).cast("bigint")


def detail_ramp(zoom: Column, full: float = 12.0) -> Column:
    """From 0 to 1 at the zoom at which everything is drawn."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), zoom / full)), 4)


def zoom_band(zooms: DataFrame, bands: DataFrame) -> DataFrame:
    """zoom, band: the first band (band, lo, hi; a few rows, which may overlap) with lo <= zoom < hi, else the first or the last one."""
    ends = bands.agg(F.min(F.struct("lo", "band")).alias("low"), F.max(F.struct("hi", "band")).alias("high"))
    hit = zooms.join(F.broadcast(bands), (F.col("lo") <= F.col("zoom")) & (F.col("zoom") < F.col("hi")), "left").groupBy("zoom").agg(F.min("band").alias("b"))  # bands are rows of the code
    return hit.crossJoin(F.broadcast(ends)).select("zoom", F.coalesce("b", F.when(F.col("zoom") < F.col("low.lo"), F.col("low.band")).otherwise(F.col("high.band"))).alias("band"))  # one row


def visible_levels(states: DataFrame, bands: DataFrame) -> DataFrame:
    """current, restricted, band: bands whose labels may be drawn in a state: those up to one past the current, the first always, all of them where labels are restricted."""
    return states.crossJoin(F.broadcast(bands.select("band"))).filter(F.col("restricted") | (F.col("band") == 0) | (F.col("band") <= F.col("current") + 1))  # bands are rows of the code


def fit_extent(points: DataFrame, group: Column | None = None, pixels: float = 1000.0, least: float = 1e-3) -> DataFrame:
    """x0, x1, y0, y1, zoom (and g, the group): the box of points (x, y) and the zoom that shows it on so many pixels; a box without extent counts as `least` wide."""
    b = points.groupBy(*([group.alias("g")] if group is not None else [])).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return b.filter("x0 is not null").withColumn("zoom", F.round(F.log2(pixels / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(least))), 6))


def cull(papers: DataFrame, selected: int | None = None, score: Column | None = None, cutoff: float = 0.0, level: Column | None = None, zoom: float | None = None, base: float = 0.0, forced: bool = False) -> DataFrame:
    """Papers that are drawn: the selected one always; of the others those whose score reaches the cutoff and whose level is at most the zoom's, unless levels are forced open."""
    keep = F.lit(True)
    if score is not None:
        keep = keep & (score >= cutoff)
    if level is not None and zoom is not None and not forced:
        keep = keep & (level <= int(max(0.0, zoom - base)))
    return papers.filter(keep if selected is None else (F.col("node") == selected) | keep)


def relevant_labels(visible: DataFrame, closure: DataFrame, share: float = 0.05, top: int = 14) -> DataFrame:
    """cell, level, votes: cells with votes from 2 on that have a share of all voters, or are among the `top` of their level.

    Each visible node (leaf) votes for its leaf and all cells above it (closure: leaf, cell, level).
    """
    leaves = visible.groupBy("leaf").agg(F.count("*").alias("c"))
    v = leaves.join(closure, "leaf").groupBy("cell", "level").agg(F.sum("c").alias("votes")).filter("votes >= 2").crossJoin(F.broadcast(leaves.agg(F.sum("c").alias("n"))))  # one row
    r = v.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("votes"), "cell")))
    return r.filter((F.col("votes") >= F.greatest(F.lit(2), share * F.col("n"))) | (F.col("r") <= top)).select("cell", "level", "votes")


def compare_sets(papers: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """node, code of papers (node): 1 in set a (node), 2 in both, 3 in b, 0 in none."""
    side = lambda s, n: s.select("node").distinct().withColumn(n, F.lit(True))
    j = papers.select("node").join(side(a, "a"), "node", "left").join(side(b, "b"), "node", "left")
    return j.select("node", F.when(F.col("a") & F.col("b"), 2).when(F.col("a"), 1).when(F.col("b"), 3).otherwise(0).alias("code"))


def compare_counts(codes: DataFrame) -> DataFrame:
    """a, b, both: sizes of the sets behind compare_sets' codes."""
    return codes.agg(F.count_if(F.col("code").isin(1, 2)).alias("a"), F.count_if(F.col("code").isin(2, 3)).alias("b"), F.count_if(F.col("code") == 2).alias("both"))


def name_search(rows: DataFrame, text: str, most: int = 40, least_chars: int = 2) -> DataFrame:
    """The rows (id, name, n) whose name contains the text in any case, greatest n first; none for a shorter text."""
    hit = rows.filter(F.contains(F.lower("name"), F.lit(text.lower()))) if len(text) >= least_chars else rows.limit(0)
    return hit.orderBy(F.desc("n"), "name", "id").limit(most)


def topic_facets(papers: DataFrame) -> DataFrame:
    """field, subfield, n, place: subfields of each field with the number of papers, the largest first."""
    n = papers.groupBy("field", "subfield").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "subfield")))


def citation_list(partners: DataFrame, text: str) -> DataFrame:
    """direction, n, hits: partners (direction, title) of a paper in each direction, and those whose title contains a text."""
    return partners.groupBy("direction").agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("title"), F.lit(text.lower()))).alias("hits"))


def tiles(points: DataFrame) -> DataFrame:
    """level, n, total: points of each level that has some, and of all up to it."""
    from skein.operators.stats import with_total

    return with_total(points, "level")


def declutter(labels: DataFrame, width: float, height: float, char: float = 0.6, pad: float = 6.0) -> DataFrame:
    """The labels (id, text, px, py, size, priority) that one screen shows: the best first, each whose box lies on the screen, meets none that is shown, and whose text is not shown.

    Boxes are char * size * length wide and size high, with `pad` around. Labels are decided in rounds: the best undecided one of each text and of each spot of the screen (so small that boxes in it always meet) is in if no better
    undecided box meets it, and what it rules out goes. This gives what one pass in order would, and a round compares as many boxes with the others as the screen has spots, at most.
    """
    from skein.sources.staging import staged

    half_w, half_h = F.length("text") * F.col("size") * char / 2 + pad, F.col("size") / 2 + pad
    boxed = labels.withColumn("hw", half_w).withColumn("hh", half_h).filter((F.col("px") - F.col("hw") >= 0) & (F.col("px") + F.col("hw") <= width) & (F.col("py") - F.col("hh") >= 0) & (F.col("py") + F.col("hh") <= height))
    left = staged(boxed.select("id", "text", "px", "py", "hw", "hh", "priority"), "labels")
    most = left.agg(F.max("hw").alias("w"), F.max("hh").alias("h"), F.min("hw").alias("lw"), F.min("hh").alias("lh")).first()
    if most.w is None:
        return labels.limit(0)
    cell = lambda c, r: F.floor(F.col(c) / (2 * r))
    side = lambda df, x: df.select(*[F.col(c).alias(f"{x}{c}") for c in ("id", "text", "px", "py", "hw", "hh", "priority")], cell("px", most.w).alias("i"), cell("py", most.h).alias("j"))
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    around = lambda df: side(df, "a").withColumn("s", steps).withColumn("i", F.col("i") + F.col("s.p")).withColumn("j", F.col("j") + F.col("s.q")).drop("s")
    better = (F.col("bpriority") > F.col("apriority")) | (F.col("bpriority") == F.col("apriority")) & (F.col("bid") < F.col("aid"))
    meets = (F.abs(F.col("apx") - F.col("bpx")) < F.col("ahw") + F.col("bhw")) & (F.abs(F.col("apy") - F.col("bpy")) < F.col("ahh") + F.col("bhh"))
    first = F.min_by(F.struct("id", "text", "px", "py", "hw", "hh", "priority"), F.struct((-F.col("priority")).alias("p"), "id")).alias("f")
    spot = (cell("px", most.lw), cell("py", most.lh)) if min(most.lw, most.lh) > 0 else (F.col("id"),)
    shown = None
    while left.limit(1).count():
        of_text = left.groupBy("text").agg(first).select("f.*")
        best = staged(left.groupBy(*spot).agg(first).select("f.*").join(of_text.select("id"), "id", "left_semi"), "label-best")
        beaten = around(best).join(side(left, "b"), ["i", "j"]).filter(better & meets).select(F.col("aid").alias("id")).distinct()
        new = staged(best.join(beaten, "id", "left_anti"), "label-new")
        out = around(new).join(side(left, "b"), ["i", "j"]).filter(meets).select(F.col("bid").alias("id")).distinct()
        left = staged(left.join(out, "id", "left_anti").join(new.select("text"), "text", "left_anti").join(new.select("id"), "id", "left_anti"), "labels", replaces=left)
        shown = staged(new.select("id") if shown is None else shown.unionByName(new.select("id")), "label-shown", replaces=shown)
    return labels.join(shown, "id", "left_semi")


def box_choice(boxes: DataFrame, captions: DataFrame, width: float = 40.0, height: float = 20.0, slack: float = 20.0) -> DataFrame:
    """page, caption, box: for each caption (page, caption, is_table, x0, y0, x1, y1) the best box (page, box, x0, y0, x1, y1) of its page in its column, a figure's above it, a table's below it.

    Boxes are at least width x height; the greatest area less 50 times the gap wins, the least box of equals.
    """
    b = boxes.select("page", "box", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")]).filter((F.col("bx1") - F.col("bx0") >= width) & (F.col("by1") - F.col("by0") >= height))
    j = captions.join(b, "page").filter((F.least("bx1", F.col("x1") + slack) - F.greatest("bx0", F.col("x0") - slack)) > 0)
    right = F.when(F.col("is_table"), F.col("by0") >= F.col("y1") - 5).otherwise(F.col("by1") <= F.col("y0") + 5)
    gap = F.when(F.col("is_table"), F.col("by0") - F.col("y1")).otherwise(F.col("y0") - F.col("by1"))
    score = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) - 50 * gap
    found = j.filter(right).withColumn("score", score).filter("score > -1")
    return found.groupBy("page", "caption").agg(F.min(F.struct((-F.col("score")).alias("s"), "box"))["box"].alias("box"))


def palette(papers: DataFrame, by: str, colours: int = 12) -> DataFrame:
    """node, colour: place of a value among all values in order, modulo the number of colours."""
    from skein.operators.corpus import dense_id

    ranks = dense_id(papers.select(by).distinct(), [by], "i")
    return papers.join(ranks, by).select("node", (F.col("i") % colours).cast("int").alias("colour"))


def recency(papers: DataFrame) -> DataFrame:
    """node, t: from 0 in the first year to 1 in the last one; 1 if there is one year alone."""
    span = papers.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return papers.crossJoin(F.broadcast(span)).select("node", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0), 6).alias("t"))  # one row


def bands(spark: SparkSession, count: int = 11, step: float = 1.2, overlap: float = 0.6) -> DataFrame:
    """band, lo, hi: zoom bands of a step each that begin `overlap` before the one below ends."""
    return spark.range(count).select(F.col("id").cast("int").alias("band"), (F.col("id") * step - overlap).alias("lo"), ((F.col("id") + 1) * step).alias("hi"))
