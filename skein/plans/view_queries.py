"""Vector, aggregation, ranking, facet, search, organisation and layout queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import month_index, search_tokens
from skein.functions.vectors import dot, norm
from skein.operators import client as CL
from skein.operators import labels as LB
from skein.operators import lookups as L
from skein.operators import orgs as O
from skein.operators import search as S
from skein.operators import shards as SH
from skein.operators import stats as ST
from skein.operators import vectors as V
from skein.operators.corpus import dense_id
from skein.operators.graph import top_per
from skein.plans.registry import Registry
from skein.operators.stats import exact_quantile
from skein.plans.tables import AUTHORSHIP, EDGES, PAPERS, TITLES, authorship, edges, papers, table, titles
from skein.sources.staging import spread
from skein.streaming.upsert import windowed

query = Registry()
DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"), "label")


@query(f"SELECT vec_id AS node, round(sqrt({DOT.format('embedding', 'embedding')}), 4) AS norm FROM embeddings")
def e1_norm(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("node", F.round(norm(F.col("v")), 4).alias("norm"))


@query(f"WITH p AS (SELECT a.vec_id AS node, b.vec_id AS nbr, round({DOT.format('a.embedding', 'b.embedding')}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) SELECT node, nbr, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, nbr)::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, nbr) <= 10")
def e2_e3_e4_c13_exact_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector is a query against all."""
    v = vectors(spark, d)
    return V.exact_neighbours(v.filter("node % 20 = 0"), v, 10)


@query()
def e3_e24_approximate_recall(spark: SparkSession, d: str) -> DataFrame:
    """hits of the exact ten nearest, of every twentieth vector, that the cells' search finds; a test wants nine tenths in all."""
    v = vectors(spark, d)
    q = v.filter("node % 20 = 0")
    cells = V.fit_cells(v, 8)
    probes = V.probes_needed(v.filter("node % 40 = 10"), v, cells, 10, 0.95)
    near = V.approximate_neighbours(q, v, cells, 10, probes)
    hit = V.exact_neighbours(q, v, 10).join(near.select("node", "nbr", F.lit(1).alias("hit")), ["node", "nbr"], "left")
    return hit.groupBy("node").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))


@query(f"SELECT vec_id AS node, round({DOT.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 4) AS score FROM embeddings ORDER BY round({DOT.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 4) DESC, vec_id LIMIT 50")
def e22_semantic_search(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    one = v.filter("node = 7").select(F.col("v").alias("q")).limit(1)
    return v.crossJoin(F.broadcast(one)).select("node", F.round(dot(F.col("v"), F.col("q")), 4).alias("score")).orderBy(F.desc("score"), "node").limit(50)  # one query row


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS s FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM s GROUP BY 1) SELECT s.label, i - 1 AS place, round(s / n, 4) AS x FROM s JOIN n USING (label)")
def e14_m19_centroids(spark: SparkSession, d: str) -> DataFrame:
    return V.centroids(vectors(spark, d), "label").select("label", F.posexplode("c").alias("place", "x")).select("label", F.col("place").cast("bigint").alias("place"), F.round("x", 4).alias("x"))


@query("WITH p AS (SELECT c_custkey AS node, c_acctbal AS x FROM customer), m AS (SELECT avg(x) AS m FROM p), s AS (SELECT quantile_cont(abs(x - m), 0.99) AS s FROM p, m) SELECT node, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END * 100, 4) AS x FROM p, m, s")
def e10_map_scale(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"))
    mean = p.agg(F.avg("x").alias("m"))
    off = p.crossJoin(F.broadcast(mean)).select("node", (F.col("x") - F.col("m")).alias("dx"))  # one row, as the next
    scale = exact_quantile(off.select(F.abs("dx").alias("x")), "x", 0.99).select(F.col("q").alias("s"))
    return off.crossJoin(F.broadcast(scale)).select("node", F.round(F.col("dx") / F.when(F.col("s") > 0, F.col("s")).otherwise(1) * 100, 4).alias("x"))


_POINTS = "SELECT c_custkey AS node, c_acctbal AS x, (c_custkey * 7919 % 1009)::DOUBLE AS y FROM customer"


@query(f"WITH p AS ({_POINTS}), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), g AS (SELECT band, pow(2, band) * 4 AS side, x, y, x0, x1, y0, y1 FROM p, b, range(4) t(band)), c AS (SELECT band, greatest(0, least(floor((x - x0) / (x1 - x0) * side), side - 1))::BIGINT AS ix, greatest(0, least(floor((y - y0) / (y1 - y0) * side), side - 1))::BIGINT AS iy, x, y FROM g) SELECT band::INT AS band, ix, iy, count(*)::BIGINT AS n, round(avg(x) + 1e-7, 4) AS cx, round(avg(y) + 1e-7, 4) AS cy, CASE WHEN band > 0 THEN ix // 2 ELSE -1 END::BIGINT AS parent_ix, CASE WHEN band > 0 THEN iy // 2 ELSE -1 END::BIGINT AS parent_iy FROM c GROUP BY band, ix, iy HAVING count(*) >= 3")
def e18_e19_quadtree(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 1009).cast("double").alias("y"))
    return V.quadtree(p, 4)


@query("WITH c AS (SELECT vec_id AS node, unnest([0, 1, 2]) AS level, label FROM embeddings), k AS (SELECT node, level, label * 10 + level AS cell FROM c WHERE node % (level + 1) = 0) SELECT node, arg_max(cell, level) AS cell FROM k GROUP BY 1")
def e20_region_leaf(spark: SparkSession, d: str) -> DataFrame:
    c = vectors(spark, d).select("node", "label", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level")).filter("node % (level + 1) = 0")
    return ST.region_leaves(c.select("node", "level", (F.col("label") * 10 + F.col("level")).alias("cell")))


@query("WITH t AS (SELECT unnest(range(60, 181)) / 200::DOUBLE AS t), s AS (SELECT label, value FROM (SELECT (user_id % 2)::INT AS label, value / 100 AS value FROM events)) SELECT round(t, 3)::DOUBLE AS t, count(*) FILTER (WHERE label = 1 AND value >= t)::BIGINT AS caught, count(*) FILTER (WHERE label = 0 AND value >= t)::BIGINT AS wrong FROM s, t GROUP BY 1")
def e25_threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    return ST.threshold_scan(table(spark, d, "events").select((F.col("user_id") % 2).alias("label"), (F.col("value") / 100).alias("score")), 60, 180, 200)


@query("SELECT event_type, round(min(value), 4) AS lo, round(quantile_cont(value, 0.05), 4) AS p05, round(median(value), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS hi FROM events GROUP BY 1")
def e25_calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    return ST.summary(table(spark, d, "events"), "event_type", "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@query(f"WITH {PAPERS}, k AS (SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS era, field, cited, (SELECT count(*) FROM lineitem WHERE l_orderkey = node) AS refs FROM papers) SELECT era, field, count(*)::BIGINT AS n, round(avg(cited), 4) AS mean, round(sum(refs)::DOUBLE / sum(cited), 4) AS ratio, round(avg((cited >= 200)::INT), 4) AS share FROM k GROUP BY 1, 2")
def e27_cohort_ratios(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.count("*").alias("refs"))
    k = papers(spark, d).join(refs, "node", "left").na.fill(0, ["refs"]).withColumn("era", F.when(F.col("year") < 1998, "early").otherwise("late"))
    return ST.cohorts(k, ["era", "field"], 200)


@query(f"WITH g AS (SELECT a.vec_id AS node, round({DOT.format('a.embedding', 'b.embedding')}, 5) AS gold FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0) SELECT node, (SELECT count(*) FROM embeddings b, embeddings a WHERE a.vec_id = g.node AND b.vec_id <> a.vec_id AND round({DOT.format('a.embedding', 'b.embedding')}, 5) > gold)::BIGINT + 1 AS rank FROM g")
def e28_gold_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector is a query against all; its gold answer is the next vector."""
    v = vectors(spark, d)
    q = v.filter("node % 20 = 0").select("node", F.col("v").alias("q")).join(v.select((F.col("node") - 1).alias("node"), F.col("v").alias("g")), "node")
    return ST.gold_ranks(q, v)


@query(f"WITH {AUTHORSHIP}, n AS (SELECT author, count(*) AS n, min(node) AS first_node FROM authorship GROUP BY 1) SELECT author, n::BIGINT AS papers, first_node, row_number() OVER (ORDER BY n DESC, author) - 1 AS author_id FROM n")
def f1_author_counts(spark: SparkSession, d: str) -> DataFrame:
    n = authorship(spark, d).groupBy("author").agg(F.count("*").alias("papers"), F.min("node").alias("first_node"))
    return dense_id(n.withColumn("_minus", -F.col("papers")), ["_minus", "author"], "author_id").drop("_minus")


@query(f"WITH {AUTHORSHIP}, {PAPERS}, x AS (SELECT a.author, p.topic AS label, count(*) AS n, sum(pow(0.5, (2001 - p.year) / 4.0)) AS w, min(p.year) AS y0, max(p.year) AS y1 FROM authorship a JOIN papers p USING (node) GROUP BY 1, 2) SELECT author, label, n::BIGINT AS n, round(w, 4) AS w, y0, y1 FROM x QUALIFY row_number() OVER (PARTITION BY author ORDER BY round(w, 4) DESC, n DESC, label) <= 3")
def f2_affiliations(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).select("node", "topic", "year")
    x = authorship(spark, d).join(p, "node").groupBy("author", F.col("topic").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(F.pow(F.lit(0.5), (2001 - F.col("year")) / 4)), 4).alias("w"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    return top_per(x, ["author"], [F.desc("w"), F.desc("n"), F.col("label")], 3).drop("rank")


@query(f"WITH {AUTHORSHIP}, o AS (SELECT DISTINCT s_nationkey AS unit, n_regionkey AS org, node FROM authorship JOIN supplier ON s_suppkey = author JOIN nation ON n_nationkey = s_nationkey), m AS (SELECT DISTINCT n_regionkey AS org, o_orderkey AS node FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), u AS (SELECT org, node, 1 AS direct FROM (SELECT DISTINCT org, node FROM o) UNION ALL SELECT org, node, 0 FROM m) SELECT org, count(DISTINCT node)::BIGINT AS papers, count(DISTINCT node) FILTER (WHERE direct = 1)::BIGINT AS direct FROM u GROUP BY 1")
def f3_f4_org_rollup(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("org")))  # 25 rows
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("author"), "org")
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "org")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    named = spread(orders.join(c, "o_custkey").select("org", F.col("o_orderkey").alias("node")), orders.count(), "org", "node")  # a customer's orders may be any number
    return O.org_rollup(authorship(spark, d).join(s, "author").select("org", "node"), named).select("org", "papers", "direct")


@query(f"WITH {AUTHORSHIP}, d AS (SELECT s_name AS name, count(DISTINCT node) AS papers FROM authorship JOIN supplier ON s_suppkey = author WHERE s_nationkey > 4 GROUP BY 1 HAVING count(DISTINCT node) >= 3) SELECT 'oa:' || name AS key, papers::BIGINT AS papers FROM d")
def f7_directory(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_name").alias("institution"), "s_nationkey")
    curated, registry = s.filter("s_nationkey <= 4").select("institution"), s.select("institution", F.col("institution").alias("display_name"), F.lit("company").alias("type")).distinct()
    return O.directory(authorship(spark, d).join(s, "author").select("institution", "node"), curated, registry).select("key", "papers")


@query(f"WITH {AUTHORSHIP}, asserted AS (SELECT DISTINCT node, author % 10 AS org FROM authorship WHERE author % 2 = 0), extracted AS (SELECT DISTINCT node, author % 10 AS org FROM authorship WHERE author % 3 = 0) SELECT org, count(*)::BIGINT AS added FROM (SELECT * FROM extracted EXCEPT SELECT * FROM asserted) GROUP BY 1")
def f8_extracted_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = lambda k: authorship(spark, d).filter(F.col("author") % k == 0).select("node", (F.col("author") % 10).alias("org"))
    return O.new_pairs(pairs(3), pairs(2)).groupBy("org").agg(F.count("*").alias("added"))


@query(f"WITH {AUTHORSHIP}, n AS (SELECT s_nationkey AS unit, s_name AS name, count(*) AS n FROM authorship JOIN supplier ON s_suppkey = author GROUP BY 1, 2) SELECT unit, name, n::BIGINT AS n, row_number() OVER (PARTITION BY unit ORDER BY n DESC, name)::INT AS rank FROM n QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, name) <= 20")
def f9_m34_top_authors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("unit"), F.col("s_name").alias("name"))
    return top_per(authorship(spark, d).join(s, "author").groupBy("unit", "name").agg(F.count("*").alias("n")), ["unit"], [F.desc("n"), F.col("name")], 20)


@query(f"WITH {PAPERS} SELECT field, topic, count(*)::BIGINT AS n, grouping(topic)::INT AS level FROM papers GROUP BY GROUPING SETS ((field), (field, topic))")
def f10_topic_tree(spark: SparkSession, d: str) -> DataFrame:
    return ST.topic_tree(papers(spark, d), ["field", "topic"])


@query(f"WITH {PAPERS}, m AS (SELECT 12 * (year - 1995) + substr(date, 6, 2)::INT - 1 AS m FROM papers), n AS (SELECT m, count(*) AS n FROM m GROUP BY 1) SELECT g.m::INT AS month, coalesce(n, 0)::BIGINT AS n, sum(coalesce(n, 0)) OVER (ORDER BY g.m)::BIGINT AS upto FROM range(0, (SELECT max(m) + 1 FROM m)) g(m) LEFT JOIN n ON n.m = g.m")
def f11_f12_g14_month_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ST.dense_months(papers(spark, d).select(month_index(F.col("date"), 1995).alias("month")))


@query(f"WITH {PAPERS}, m AS (SELECT 12 * (year - 1995) + substr(date, 6, 2)::INT - 1 AS m FROM papers), s AS (SELECT min(s) AS step FROM (VALUES (1), (3), (6), (12), (24), (60)) v(s) WHERE ceil(((SELECT max(m) + 1 FROM m))::DOUBLE / s) <= 56) SELECT (m // step)::BIGINT AS bar, count(*)::BIGINT AS n, count(*) FILTER (WHERE m BETWEEN 10 AND 40)::BIGINT AS inside FROM m, s GROUP BY 1")
def f13_f14_bars(spark: SparkSession, d: str) -> DataFrame:
    return ST.bars(papers(spark, d).select(month_index(F.col("date"), 1995).alias("month")), 10, 40)


@query(f"WITH {PAPERS} SELECT s::INT AS step, round(exp(s / 48.0 * (SELECT ln(1 + max(cited)) FROM papers)) - 1)::BIGINT AS cited FROM range(49) g(s)")
def f15_citation_steps(spark: SparkSession, d: str) -> DataFrame:
    return ST.log_steps(papers(spark, d))


@query(f"WITH {PAPERS}, g AS (SELECT (node % 7)::BIGINT AS level, count(*)::BIGINT AS n, min(cited)::BIGINT AS least, median(cited)::DOUBLE AS middle FROM papers GROUP BY 1) SELECT *, sum(n) OVER (ORDER BY level)::BIGINT AS upto FROM g")
def f16_level_stats(spark: SparkSession, d: str) -> DataFrame:
    return ST.level_stats(papers(spark, d).select((F.col("node") % 7).alias("level"), "cited"))


@query("SELECT c_mktsegment AS name, count(*)::BIGINT AS ids, sum(c_nationkey)::BIGINT AS total, min(c_custkey) AS first_id FROM customer GROUP BY 1")
def f17_h9_same_name_groups(spark: SparkSession, d: str) -> DataFrame:
    return O.same_name_groups(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("papers"))).withColumnRenamed("papers", "total")


@query("SELECT round(avg((quality IS NOT NULL)::INT), 6) AS coverage, round(avg((quality = 1)::INT), 6) AS good FROM documents LEFT JOIN labels USING (doc_id)")
def f18_f19_coverage(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    got = ST.coverage(j, {"coverage": F.col("quality").isNotNull()}).crossJoin(ST.coverage(j.filter("quality is not null"), {"good": F.col("quality") == 1}))
    return got  # one row each


@query("SELECT p_type AS category, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 12")
def f21_category_census(spark: SparkSession, d: str) -> DataFrame:
    return ST.census(table(spark, d, "part").select(F.col("p_type").alias("category")), "category", 12)


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type AS majority FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def f22_majority(spark: SparkSession, d: str) -> DataFrame:
    return ST.majority(table(spark, d, "events"), "user_id", "event_type")


@query(f"WITH {PAPERS}, m AS (SELECT median(year) AS m FROM papers) SELECT node, round(cited / sqrt(greatest(2002.0 - (coalesce(CASE WHEN node % 9 > 0 THEN year END, m) + 0.5), 0.5)), 4) AS importance FROM papers, m")
def g1_importance(spark: SparkSession, d: str) -> DataFrame:
    return ST.importance(papers(spark, d).withColumn("year", F.when(F.col("node") % 9 > 0, F.col("year"))), 2002.0)


@query(f"WITH {PAPERS} SELECT node, cited FROM papers WHERE date BETWEEN '1997-01-01' AND '1999-12-31' AND topic = '1-URGENT' ORDER BY cited DESC, node LIMIT 500")
def g5_g7_g8_result_list(spark: SparkSession, d: str) -> DataFrame:
    match = F.col("date").between("1997-01-01", "1999-12-31") & (F.col("topic") == "1-URGENT")
    return CL.result_list(papers(spark, d).select("node", "cited", "date", "topic"), match).select("node", "cited")


@query(f"WITH {PAPERS}, r AS (SELECT node, row_number() OVER (ORDER BY cited DESC, node) - 1 AS i, count(*) OVER () AS n FROM papers) SELECT node, i FROM r WHERE i % greatest(1, ceil(n / 2000.0)::BIGINT) = 0")
def g6_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).withColumn("_minus", -F.col("cited"))
    r = dense_id(p, ["_minus", "node"], "i").crossJoin(F.broadcast(p.agg(F.count("*").alias("n"))))  # one row
    return r.filter(F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / 2000)) == 0).select("node", "i")


@query("WITH n AS (SELECT label AS band, vec_id % 4 AS g, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT band, g, round((10 - band) * 1000 + n * 100.0 / max(n) OVER (PARTITION BY band), 2)::DOUBLE AS priority FROM n")
def g10_label_priority(spark: SparkSession, d: str) -> DataFrame:
    n = vectors(spark, d).groupBy(F.col("label").alias("band"), (F.col("node") % 4).alias("g")).agg(F.count("*").alias("n"))
    return CL.label_priority(n, 10).select("band", "g", "priority")


@query("WITH b AS (SELECT i AS band, i * 1.2 - 0.6 AS lo, (i + 1) * 1.2 AS hi FROM range(11) r(i)), z AS (SELECT i / 4.0 AS zoom FROM range(60) r(i)) SELECT zoom::DOUBLE AS zoom, coalesce((SELECT min(band) FROM b WHERE lo <= zoom AND zoom < hi), CASE WHEN zoom < 0 THEN 0 ELSE 10 END)::INT AS band FROM z")
def g15_zoom_band(spark: SparkSession, d: str) -> DataFrame:
    return CL.zoom_band(spark.range(60).select((F.col("id") / 4).alias("zoom")), CL.bands(spark))


@query(f"WITH {PAPERS}, {AUTHORSHIP} SELECT p.node, p.cited FROM papers p WHERE p.node IN (SELECT node FROM authorship WHERE author IN (1, 2, 3)) AND p.node IN (SELECT node FROM authorship JOIN supplier ON s_suppkey = author WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 2))) AND p.topic IN ('1-URGENT', '2-HIGH') AND p.cited BETWEEN 50 AND 400 AND p.date BETWEEN '1995-06-01' AND '2000-06-30'")
def h1_h2_h5_facets(spark: SparkSession, d: str) -> DataFrame:
    from skein.plans.filters import FilterSpec

    orgs = authorship(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("n_nationkey")), "author").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("value"))), "n_nationkey").select("node", "value")  # 25 nations
    spec = FilterSpec(members={"author": [1, 2, 3], "org": [0, 1, 2]}, values={"topic": ["1-URGENT", "2-HIGH"]}, ranges={"cited": (50, 400), "date": ("1995-06-01", "2000-06-30")})
    return spec.apply(papers(spark, d), {"author": authorship(spark, d).select("node", F.col("author").alias("value")), "org": orgs}).select("node", "cited")


@query(f"WITH {AUTHORSHIP}, a AS (SELECT DISTINCT node FROM authorship WHERE author < 20), b AS (SELECT DISTINCT node FROM authorship WHERE author >= 15 AND author < 60) SELECT o_orderkey AS node, CASE WHEN a.node IS NOT NULL AND b.node IS NOT NULL THEN 2 WHEN a.node IS NOT NULL THEN 1 WHEN b.node IS NOT NULL THEN 3 ELSE 0 END::INT AS code FROM orders LEFT JOIN a ON a.node = o_orderkey LEFT JOIN b ON b.node = o_orderkey")
def h7_compare_sets(spark: SparkSession, d: str) -> DataFrame:
    a = authorship(spark, d)
    return CL.compare_sets(papers(spark, d), a.filter("author < 20"), a.filter("author >= 15 and author < 60"))


@query(f"WITH {AUTHORSHIP} SELECT node, arg_min(s_nationkey, s_nationkey * 7 % 25) AS org FROM authorship JOIN supplier ON s_suppkey = author WHERE s_nationkey < 20 GROUP BY 1")
def h8_org_of_node(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("org"))
    order = spark.range(20).select(F.col("id").cast("int").alias("org"), (F.col("id") * 7 % 25).alias("position"))
    return O.org_of_node(authorship(spark, d).join(s, "author").select("node", "org"), order)


@query(f"WITH {EDGES} SELECT dst AS node FROM edges WHERE src IN (100, 101) AND dst NOT IN (100, 101) UNION SELECT src FROM edges WHERE dst IN (100, 101) AND src NOT IN (100, 101)")
def h10_neighbour_union(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbour_union(edges(spark, d), [100, 101])


@query("SELECT p_partkey AS id, p_type AS name, p_size AS n FROM part WHERE contains(lower(p_type), 'el') ORDER BY n DESC, name, id LIMIT 40")
def h13_h14_m24_directory_search(spark: SparkSession, d: str) -> DataFrame:
    return CL.name_search(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_size").alias("n")), "el")


_TOKENS = f"{TITLES}, t AS (SELECT doc_id AS node, n_chars AS cited, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: len(x) >= 2))) AS token FROM titles)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select(F.col("doc_id").alias("node"), "title", F.col("n_chars").alias("cited"))


@query(f"WITH {_TOKENS}, r AS (SELECT *, count(*) OVER (PARTITION BY token) > 50 AS capped, row_number() OVER (PARTITION BY token ORDER BY cited DESC, node) AS k FROM t) SELECT token, node, capped FROM r WHERE k <= 50")
def i1_i2_i4_title_index(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(_docs(spark, d), 50).select("token", "node", "capped")


@query(f"WITH {_TOKENS}, u AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT token FROM t)) SELECT (i // ceil(n / 64.0)::BIGINT)::BIGINT AS chunk, min(token) AS first, max(token) AS last, count(*)::BIGINT AS tokens FROM u GROUP BY 1")
def i3_i5_alphabet_chunks(spark: SparkSession, d: str) -> DataFrame:
    tokens = _docs(spark, d).select(F.explode(search_tokens(F.col("title"))).alias("token"))
    return S.chunks(tokens, 64)


@query(f"""WITH {_TOKENS}, r AS (SELECT *, count(*) OVER (PARTITION BY token) > 50 AS capped, row_number() OVER (PARTITION BY token ORDER BY cited DESC, node) AS k FROM t), ix AS (SELECT * FROM r WHERE k <= 50),
w AS (SELECT 'the' AS word, false AS pre UNION ALL SELECT 'er', true), p AS (SELECT token FROM (SELECT DISTINCT token FROM ix WHERE starts_with(token, 'er') AND token <> 'er') ORDER BY token LIMIT 63),
h AS (SELECT word, node, cited, capped, 1 AS same FROM ix JOIN w ON token = word UNION ALL SELECT 'er', node, cited, capped, 0 FROM ix WHERE token IN (SELECT token FROM p)),
s AS (SELECT w.word, coalesce(bool_or(capped), false) AS capped FROM w LEFT JOIN h ON h.word = w.word GROUP BY 1), per AS (SELECT h.word, node, max(cited) AS cited, max(same) AS same FROM h GROUP BY 1, 2),
f AS (SELECT node, max(cited) AS cited, sum(same) AS exact, count(*) FILTER (WHERE s.capped) AS sampled, count(*) FILTER (WHERE NOT s.capped) AS met, count(*) AS all_met, max((per.word = 'the')::INT) AS first FROM per JOIN s ON s.word = per.word GROUP BY 1),
k AS (SELECT * FROM f WHERE met = (SELECT count(*) FROM s WHERE NOT capped)), fl AS (SELECT bool_or(all_met = 2) AS full FROM k)
SELECT node, exact::INT AS exact, sampled::INT AS sampled, cited FROM k, fl WHERE (SELECT count(*) FROM s WHERE NOT capped) > 0 OR (fl.full AND all_met = 2) OR (NOT fl.full AND first = 1) ORDER BY exact DESC, sampled DESC, cited DESC, node LIMIT 40""")
def i6_i7_title_search(spark: SparkSession, d: str) -> DataFrame:
    return S.title_search(S.postings(_docs(spark, d), 50), "the er", 40)


@query(f"WITH {TITLES}, m AS (SELECT doc_id, title, n_chars, CASE WHEN regexp_matches(lower(title), '\\bthe\\b') THEN 2 WHEN regexp_matches(lower(title), '\\bthe') THEN 1 ELSE 0 END AS rank, strpos(lower(title), 'the') AS place FROM titles WHERE contains(lower(title), 'the')) SELECT doc_id, rank::INT AS rank, place::INT AS place FROM m ORDER BY rank DESC, place, n_chars DESC, doc_id LIMIT 25")
def i8_i9_m25_m26_match_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = titles(spark, d).select(F.col("doc_id").alias("node"), "title", F.col("n_chars").alias("cited"))
    return LB.match_rank(rows, "the", 25).select(F.col("node").alias("doc_id"), "rank", "place")


@query("SELECT p_type AS text, max(p_size)::INT AS priority, max(starts_with(lower(p_type), 'st')::INT)::INT AS starts FROM part WHERE contains(lower(p_type), 'st') GROUP BY 1 ORDER BY priority DESC, starts DESC, text LIMIT 4")
def i10_i11_label_search(spark: SparkSession, d: str) -> DataFrame:
    return LB.label_search(table(spark, d, "part").select(F.col("p_type").alias("text"), F.col("p_size").alias("priority")), "st")


@query(f"""WITH {TITLES}, w AS (SELECT source AS set, doc_id, list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for')) AS w FROM titles),
g AS (SELECT set, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT set, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), tot AS (SELECT set, sum(tf) AS total FROM tf GROUP BY 1), n AS (SELECT source AS set, count(*) AS titles FROM titles GROUP BY 1),
s AS (SELECT tf.set, tf.term, tf, df, round(tf::DOUBLE / total * ln(1 + (SELECT count(*) FROM n)::DOUBLE / (1 + df)), 6) AS score FROM tf JOIN df USING (term) JOIN tot ON tot.set = tf.set JOIN n ON n.set = tf.set WHERE tf >= 2 OR titles <= 4)
SELECT set, term, tf::BIGINT AS tf, df::BIGINT AS df, score FROM s QUALIFY row_number() OVER (PARTITION BY set ORDER BY score DESC, term) <= 4""")
def i12_i13_set_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.set_label_terms(titles(spark, d).select(F.col("source").alias("set"), F.col("doc_id").alias("node"), "title"), ["the", "and", "for"], 4)


@query(f"WITH {PAPERS}, g AS (SELECT topic, count(*) AS n FROM papers GROUP BY 1), c AS (SELECT field AS region, topic, count(*) AS n FROM papers GROUP BY 1, 2), t AS (SELECT field AS region, count(*) AS total FROM papers GROUP BY 1) SELECT region, topic, round(c.n::DOUBLE / total * ln(1 + (SELECT count(*) FROM papers)::DOUBLE / g.n) * ln(1 + c.n), 5) AS score FROM c JOIN g USING (topic) JOIN t USING (region) WHERE c.n >= greatest(2, ceil(0.01 * total)) QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, topic) <= 8")
def i14_topic_candidates(spark: SparkSession, d: str) -> DataFrame:
    return LB.topic_candidates(papers(spark, d).select(F.col("field").alias("region"), "topic"))


_UNITS = [("spam", "spam|casino"), ("blog", "blog"), ("mobile", "^m\\.|//m\\."), ("plain", "example")]


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{u}'" for u, p in _UNITS) + " END AS unit FROM pages WHERE " + " OR ".join(f"regexp_matches(url, '{p}')" for _, p in _UNITS))
def j1_unit_extraction(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.orgs import first_unit

    return first_unit(table(spark, d, "pages").select("page_id", F.col("url").alias("text")), ["page_id"], _UNITS).select("page_id", "unit")


@query("SELECT page_id, unit FROM (SELECT page_id, unnest([CASE WHEN regexp_matches(url, 'example') AND NOT regexp_matches(url, 'spam') THEN 'example' END, CASE WHEN regexp_matches(url, 'blog') THEN 'blog' END, CASE WHEN regexp_matches(url, 'net') AND NOT regexp_matches(url, 'www') THEN 'net' END]) AS unit FROM pages) WHERE unit IS NOT NULL")
def j2_j3_name_matchers(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.orgs import all_matches

    rules = [("example", "example", "spam"), ("blog", "blog", None), ("net", "net", "www")]
    return all_matches(table(spark, d, "pages").select("page_id", F.col("url").alias("text")), ["page_id"], rules).select("page_id", "unit")


@query("SELECT l_orderkey AS node, string_agg(s_name, '|' ORDER BY s_name) AS raw, count(*)::INT AS n FROM (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s_name) <= 1000) GROUP BY 1")
def j6_affiliation_strings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    g = O.affiliation_strings(li.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("text")), "s_suppkey"), 1000)
    return g.select("node", F.array_join("strings", "|").alias("raw"), F.size("strings").alias("n"))


@query("SELECT o_orderkey // 2048 AS shard, count(*)::BIGINT AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1")
def k1_k2_k3_shards(spark: SparkSession, d: str) -> DataFrame:
    return SH.shard_sizes(papers(spark, d), "node", 2048)


@query(f"WITH {AUTHORSHIP} SELECT author // 64 AS shard, author, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM authorship GROUP BY 1, 2")
def k4_k5_author_shards(spark: SparkSession, d: str) -> DataFrame:
    return SH.inverted(authorship(spark, d), "author", "node", 64).select("shard", "author", F.array_join("nodes", ",").alias("nodes"))


@query("SELECT s_name AS key, (row_number() OVER (ORDER BY s_name) - 1) // 128 AS shard FROM supplier")
def k6_k7_directory_shards(spark: SparkSession, d: str) -> DataFrame:
    return SH.dense_shards(table(spark, d, "supplier").select(F.col("s_name").alias("key")), "key", 128)


@query("SELECT page_id, regexp_replace('2401.' || page_id || 'v' || (page_id % 5 + 1), 'v[0-9]+$', '') AS arxiv FROM pages")
def k8_import_index(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("2401."), F.col("page_id"), F.lit("v"), (F.col("page_id") % 5 + 1).cast("int"))
    return SH.import_index(table(spark, d, "pages").select(F.col("page_id").alias("node"), raw.alias("arxiv_id"))).select(F.col("node").alias("page_id"), "arxiv")


@query(f"WITH {PAPERS} SELECT node, ((dense_rank() OVER (ORDER BY topic) - 1) % 12)::INT AS colour FROM papers")
def k10_m30_palette(spark: SparkSession, d: str) -> DataFrame:
    return CL.palette(papers(spark, d), "topic")


@query(f"WITH {EDGES} SELECT 'edge end unknown' AS violation, count(*)::BIGINT AS n FROM edges WHERE dst NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'ids not dense', (max(o_orderkey) + 1 - count(*))::BIGINT FROM orders")
def m23_bundle_checks(spark: SparkSession, d: str) -> DataFrame:
    return L.bundle_violations(papers(spark, d), edges(spark, d)).filter(F.col("violation").isin("edge end unknown", "ids not dense"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(sum(value), 3) AS v FROM events GROUP BY 1, 2")
def x_windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the itemised operators: tumbling windows over the event table."""
    w = windowed(table(spark, d, "events"), "user_id", "ts", "value", "1 hour")
    return w.select("user_id", F.col("window.start").alias("hour"), "n", F.round("v", 3).alias("v"))
