"""Joins and citation-graph queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import lookups as L
from skein.plans.registry import Registry
from skein.plans.tables import AUTHORSHIP, CITATIONS, EDGES, PAPERS, authorship, citations, edges, papers, table
from skein.sources.staging import staged

query = Registry()
#: Pivots of more edges make no candidates of D2 and D3.
HUB_DEGREE_LIMIT = 1000


@query(f"WITH {CITATIONS} SELECT c.src, c.dst FROM citations c JOIN orders o ON c.dst = o.o_orderkey WHERE c.src <> c.dst")
def c1_resolve_references(spark: SparkSession, d: str) -> DataFrame:
    refs = citations(spark, d).select(F.col("src").alias("node_id"), F.col("dst").alias("work"))
    return G.resolve(refs, papers(spark, d).select(F.col("node").alias("work"), F.col("node").alias("node_id")))


@query("WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey // 2 AS provider FROM lineitem), p AS (SELECT s_suppkey // 2 AS provider, min(s_suppkey) AS paper, count(*) - 1 AS clashes FROM supplier GROUP BY 1) SELECT c.l_orderkey AS node, p.paper, p.clashes::BIGINT AS clashes FROM c JOIN p USING (provider)")
def c2_provider_reference(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.floor(F.col("l_suppkey") / 2).alias("provider"))
    return L.provider_references(refs, table(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 2).alias("provider"), F.col("s_suppkey").alias("paper"), F.col("s_suppkey").alias("position")))


@query("SELECT DISTINCT o_orderkey AS node, c_custkey AS corpus_id FROM orders JOIN customer ON o_custkey % 500 = c_custkey % 500 WHERE c_nationkey < 5")
def c3_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 500).alias("k"))
    return L.crosswalk(o, table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("corpus_id"), (F.col("c_custkey") % 500).alias("k")), "k")


@query("WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey AND l_orderkey IN (SELECT * FROM o) AND l_partkey IN (SELECT * FROM o)")
def c4_c5_d7_project_edges(spark: SparkSession, d: str) -> DataFrame:
    lists = citations(spark, d).groupBy(F.col("src").alias("key")).agg(F.collect_list("dst").alias("neighbors"))
    ids = papers(spark, d).filter("field = 'O'").select(F.col("node").alias("outside"), F.col("node").alias("node_id"))
    return G.project(lists, ids)


@query("SELECT o_orderkey AS node, coalesce(bool_or(l_returnflag = 'R'), false) AS any_returned, coalesce(max(l_quantity), 0)::DOUBLE AS most FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def c6_collapse_fan_out(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), "l_returnflag", "l_quantity")
    return L.collapse(papers(spark, d), flags, {"any_returned": F.col("l_returnflag") == "R"}, {"most": F.col("l_quantity")})


@query(f"WITH {PAPERS}, {CITATIONS}, n AS (SELECT dst, count(*) AS n FROM citations GROUP BY 1) SELECT node, coalesce(n, 0)::BIGINT AS n FROM papers LEFT JOIN n ON node = dst")
def c7_c8_m1_attach_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.attach_counts(papers(spark, d).select("node"), citations(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")))


@query(f"WITH {PAPERS}, {AUTHORSHIP}, claims AS (SELECT s_suppkey AS author, s_nationkey AS org, (1995 + s_suppkey % 3)::VARCHAR || '-06-01' AS valid_from, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '1999-12-31' END AS valid_to FROM supplier WHERE s_suppkey % 2 = 0) SELECT DISTINCT c.org, p.node FROM authorship a JOIN claims c USING (author) JOIN papers p USING (node) WHERE p.date >= c.valid_from AND (c.valid_to IS NULL OR p.date <= c.valid_to)")
def c9_roster_in_time(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_suppkey % 2 = 0")
    claims = s.select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("org"), F.concat((1995 + F.col("s_suppkey") % 3).cast("string"), F.lit("-06-01")).alias("valid_from"), F.when(F.col("s_suppkey") % 4 == 0, None).otherwise("1999-12-31").alias("valid_to"))
    return L.claims_in_time(authorship(spark, d), claims, papers(spark, d)).select("org", "node").distinct()


@query("SELECT s_name AS ror, count(*)::BIGINT AS n FROM supplier WHERE regexp_extract(s_name, '([^#]+)$', 1) NOT IN (SELECT regexp_extract(c_name, '([^#]+)$', 1) FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 ORDER BY n DESC, ror LIMIT 5")
def c10_f20_unmapped(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.regexp_extract("c_name", "([^#]+)$", 1).alias("segment"))
    return L.top_counts(L.bridge(table(spark, d, "supplier").select(F.col("s_name").alias("ror")), "ror", known)[1], "ror", 5)


@query("WITH x AS (SELECT o_custkey AS author, o_orderkey AS node, epoch(o_orderdate)::BIGINT // 86400 AS day FROM orders) SELECT author, node, arg_min(other, gap * 100000000 + other) AS nearest, min(gap)::BIGINT AS gap FROM (SELECT a.author, a.node, b.node AS other, abs(a.day - b.day) AS gap FROM x a JOIN x b ON a.author = b.author AND a.node <> b.node) WHERE gap <= 365 GROUP BY 1, 2")
def c11_nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("node"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("day"))
    return L.nearest_in_time(x).filter("gap <= 365").withColumnRenamed("key", "author")


@query("SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def c15_not_live(spark: SparkSession, d: str) -> DataFrame:
    return L.not_in(papers(spark, d).select("node"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node")), "node")


@query("WITH RECURSIVE up AS (SELECT n_nationkey AS leaf, n_nationkey AS ancestor, 0 AS hops FROM nation UNION ALL SELECT leaf, ancestor // 2, hops + 1 FROM up WHERE ancestor > 0 AND hops < 64) SELECT leaf, ancestor, hops FROM up")
def c17_region_closure(spark: SparkSession, d: str) -> DataFrame:
    """A region's parent is half its number here, up to 0."""
    tree = spark.range(25).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("parent"))
    up = L.ancestors(tree).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("leaf")), "leaf", "left_semi")
    return up.select(F.col("leaf").cast("int").alias("leaf"), F.col("ancestor").cast("int").alias("ancestor"), "hops")


@query(f"WITH {AUTHORSHIP} SELECT s.s_nationkey AS org, count(DISTINCT a.node)::BIGINT AS papers FROM supplier s JOIN authorship a ON a.author = s.s_suppkey GROUP BY 1")
def c18_org_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("org"))
    return L.members(authorship(spark, d), s).groupBy("org").agg(F.count("*").alias("papers"))


@query(f"WITH {EDGES}, r AS (SELECT src AS node, count(*) AS n_refs, min(dst) AS first_ref, max(dst) AS last_ref FROM edges GROUP BY 1), c AS (SELECT dst AS node, count(*) AS n_citers, min(src) AS first_citer FROM edges GROUP BY 1) SELECT coalesce(r.node, c.node) AS node, coalesce(n_refs, 0)::INT AS n_refs, first_ref, last_ref, coalesce(n_citers, 0)::INT AS n_citers, first_citer FROM r FULL JOIN c ON r.node = c.node")
def d1_d8_adjacency(spark: SparkSession, d: str) -> DataFrame:
    a = G.adjacency(edges(spark, d))
    return a.select("node", F.size("refs").alias("n_refs"), F.get("refs", F.lit(0)).alias("first_ref"), F.try_element_at("refs", F.lit(-1)).alias("last_ref"), F.size("cited_by").alias("n_citers"), F.get("cited_by", F.lit(0)).alias("first_citer"))


SHARED = f"""{EDGES}, deg AS (SELECT dst AS p, count(*) AS n FROM edges GROUP BY 1), dego AS (SELECT src AS p, count(*) AS n FROM edges GROUP BY 1),
k AS (SELECT e.* FROM edges e JOIN deg ON e.dst = deg.p WHERE deg.n <= {HUB_DEGREE_LIMIT}), ko AS (SELECT e.* FROM edges e JOIN dego ON e.src = dego.p WHERE dego.n <= {HUB_DEGREE_LIMIT}),
refs AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM k x JOIN k y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2), citers AS (SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM ko x JOIN ko y ON x.src = y.src AND x.dst <> y.dst GROUP BY 1, 2),
shared AS (SELECT coalesce(r.a, c.a) AS a, coalesce(r.b, c.b) AS b, coalesce(r.n, 0)::BIGINT AS refs, coalesce(c.n, 0)::BIGINT AS citers FROM refs r FULL JOIN citers c ON r.a = c.a AND r.b = c.b)"""


_TOP = "t AS (SELECT a, b, refs + citers AS overlap FROM shared QUALIFY row_number() OVER (PARTITION BY a ORDER BY refs + citers DESC, b) <= 10), direct AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), cand AS (SELECT a, b, overlap::BIGINT AS overlap FROM t UNION SELECT d.a, d.b, coalesce(s.refs + s.citers, 0)::BIGINT FROM direct d LEFT JOIN shared s ON s.a = d.a AND s.b = d.b)"


#: The same through pivots of any degree.
SHARED_BY_ALL = f"""{EDGES}, refs AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM edges x JOIN edges y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2), citers AS (SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM edges x JOIN edges y ON x.src = y.src AND x.dst <> y.dst GROUP BY 1, 2),
shared AS (SELECT coalesce(r.a, c.a) AS a, coalesce(r.b, c.b) AS b, coalesce(r.n, 0)::BIGINT AS refs, coalesce(c.n, 0)::BIGINT AS citers FROM refs r FULL JOIN citers c ON r.a = c.a AND r.b = c.b)"""


@query(f"WITH {SHARED_BY_ALL}, {_TOP} SELECT * FROM cand")
def d4_citation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten of most shared works, through pivots of any degree, and all that are directly linked."""
    return G.citation_candidates(staged(edges(spark, d), "edges"), 10)


@query(f"""WITH {SHARED}, {_TOP}, ar AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM edges x JOIN edges y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2), ac AS (SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM edges x JOIN edges y ON x.src = y.src AND x.dst <> y.dst GROUP BY 1, 2)
SELECT c.a, c.b, round(CASE WHEN d.a IS NOT NULL THEN 1.0 ELSE 0.5 * (CASE WHEN ar.n > 0 THEN ar.n::DOUBLE / (coalesce(oa.n, 0) + coalesce(ob.n, 0) - ar.n) ELSE 0 END + CASE WHEN ac.n > 0 THEN ac.n::DOUBLE / (coalesce(ia.n, 0) + coalesce(ib.n, 0) - ac.n) ELSE 0 END) END, 6) AS score
FROM (SELECT DISTINCT a, b FROM cand) c LEFT JOIN ar ON ar.a = c.a AND ar.b = c.b LEFT JOIN ac ON ac.a = c.a AND ac.b = c.b LEFT JOIN direct d ON d.a = c.a AND d.b = c.b LEFT JOIN dego oa ON oa.p = c.a LEFT JOIN dego ob ON ob.p = c.b LEFT JOIN deg ia ON ia.p = c.a LEFT JOIN deg ib ON ib.p = c.b""")
def d2_d3_citation_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of candidates as D4's, made by pivots of up to HUB_DEGREE_LIMIT edges, with shared works of any degree."""
    return G.scored_candidates(edges(spark, d), 10, HUB_DEGREE_LIMIT).withColumn("score", F.round("score", 6))


@query(f"WITH known AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus = 'O'), {CITATIONS}, i AS (SELECT dst AS node, count(*) AS n FROM citations GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM citations GROUP BY 1), e AS (SELECT dst AS node, count(DISTINCT src) AS n FROM citations WHERE src <> dst AND src IN (SELECT node FROM known) GROUP BY 1) SELECT k.node, coalesce(i.n, 0)::BIGINT AS incoming, coalesce(o.n, 0)::BIGINT AS outgoing, coalesce(e.n, 0)::BIGINT AS internal FROM known k LEFT JOIN i USING (node) LEFT JOIN o USING (node) LEFT JOIN e USING (node)")
def d9_citation_totals(spark: SparkSession, d: str) -> DataFrame:
    return G.citation_totals(citations(spark, d), papers(spark, d).filter("field = 'O'").select("node"))


@query(f"WITH {PAPERS}, auth AS (SELECT l_orderkey AS node, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT node, coalesce(n, cited)::BIGINT AS cited, (n IS NOT NULL OR cited > 100) AS available FROM papers LEFT JOIN auth USING (node)")
def d10_d12_authoritative(spark: SparkSession, d: str) -> DataFrame:
    auth = table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("node")).agg(F.sum("l_linenumber").alias("n"))
    return L.authoritative(papers(spark, d).select("node", "cited", (F.col("cited") > 100).alias("available")), auth).select("node", "cited", "available")


@query(f"WITH {PAPERS}, primary_s2 AS (SELECT bool_or(o_orderstatus = 'P') AS x FROM orders) SELECT node, CASE WHEN (SELECT x FROM primary_s2) THEN cited ELSE cited * 2 END::BIGINT AS cited FROM papers")
def d11_provider_materialise(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    primary = bool(p.filter("field = 'P'").limit(1).count())
    return L.provider_materialise(p.select("node", "cited"), p.select("node", (F.col("cited") * 2).alias("n")), primary).select("node", "cited")


@query(f"WITH {PAPERS}, {EDGES}, n AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1), g AS (SELECT l_partkey AS node, count(*) AS g FROM lineitem GROUP BY 1), m AS (SELECT p.node, greatest(cited // 10, coalesce(g, 0), coalesce(n, 0)) AS cited_by, coalesce(n, 0) AS n FROM papers p LEFT JOIN n USING (node) LEFT JOIN g USING (node)) SELECT node, cited_by::BIGINT AS cited_by, n >= cited_by AS enumerable FROM m")
def d13_citation_floor(spark: SparkSession, d: str) -> DataFrame:
    own = papers(spark, d).select("node", F.floor(F.col("cited") / 10).alias("cited"))
    given = citations(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("provided"))
    return G.citation_floor(own, given, edges(spark, d))


@query("SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'O' END IS TRUE OR (o_orderstatus = 'P' AND count(l_orderkey) > 0) AS available, CASE WHEN CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'O' END IS TRUE OR (o_orderstatus = 'P' AND count(l_orderkey) > 0) THEN count(l_orderkey) ELSE -1 END::BIGINT AS reference_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def d14_d15_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    n = citations(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return L.reference_counts(papers(spark, d).select("node", F.when(F.col("field") == "P", None).otherwise(F.col("field") == "O").alias("flag")), n)


@query(f"WITH {PAPERS}, {EDGES}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d.cited DESC, dst) AS ks, row_number() OVER (PARTITION BY dst ORDER BY s.cited DESC, src) AS kd FROM edges JOIN papers s ON s.node = src JOIN papers d ON d.node = dst) SELECT src, dst FROM r WHERE ks <= 3 OR kd <= 3")
def d16_edge_cap(spark: SparkSession, d: str) -> DataFrame:
    return G.cap_edges(edges(spark, d), papers(spark, d).select("node", F.col("cited").alias("w")), 3)


@query(f"WITH {EDGES}, t AS (SELECT greatest(src % 7, dst % 7) AS tier, count(*) AS n FROM edges WHERE src IN (SELECT o_orderkey FROM orders) AND dst IN (SELECT o_orderkey FROM orders) GROUP BY 1) SELECT tier, n::BIGINT AS n, sum(n) OVER (ORDER BY tier)::BIGINT AS total FROM t")
def d17_edge_tiers(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_tiers(edges(spark, d), papers(spark, d).select("node", (F.col("node") % 7).alias("level")))


@query(f"WITH {EDGES}, s AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1), t AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1) SELECT o_orderkey // 2048 AS shard, o_orderkey AS node, coalesce(s.n, 0)::INT AS n_refs, coalesce(t.n, 0)::INT AS n_citers FROM orders LEFT JOIN s ON s.node = o_orderkey LEFT JOIN t ON t.node = o_orderkey")
def d18_node_shards(spark: SparkSession, d: str) -> DataFrame:
    a = papers(spark, d).select("node").join(G.adjacency(edges(spark, d)), "node", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return a.select(F.floor(F.col("node") / 2048).alias("shard"), "node", F.when(F.col("refs").isNull(), 0).otherwise(size("refs")).alias("n_refs"), F.when(F.col("cited_by").isNull(), 0).otherwise(size("cited_by")).alias("n_citers"))


@query(f"""WITH {EDGES}, {PAPERS}, refs AS (SELECT DISTINCT dst AS node FROM edges WHERE src = 100), citers AS (SELECT DISTINCT src AS node FROM edges WHERE dst = 100),
m AS (SELECT node, 'ref' AS direction FROM refs UNION ALL SELECT node, 'citer' FROM citers WHERE node NOT IN (SELECT node FROM refs)),
raw AS (SELECT m.node, m.direction, (SELECT count(*) FROM edges e WHERE e.src = m.node AND e.dst IN (SELECT node FROM refs)) + (SELECT count(*) FROM edges e WHERE e.dst = m.node AND e.src IN (SELECT node FROM citers)) + 1 AS raw FROM m)
SELECT node, round(raw::DOUBLE / (SELECT max(raw) FROM raw), 6) AS score, direction FROM raw UNION ALL SELECT 100::BIGINT, 1.0::DOUBLE, 'self'""")
def d19_relevance(spark: SparkSession, d: str) -> DataFrame:
    return G.relevance(edges(spark, d), papers(spark, d).select("node", "cited"), 100)


@query(f"WITH {EDGES}, s AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM s) SELECT t::DOUBLE AS t, CASE WHEN t <= 0 THEN 0.0 ELSE round((SELECT n FROM r WHERE k = floor(t * c)::BIGINT LIMIT 1) + 1e-6, 6) END::DOUBLE AS cutoff FROM (VALUES (0.0), (0.25), (0.5), (0.9)) v(t)")
def d20_relevance_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The t-quantiles of a score, found from the counts of its distinct values."""
    n = G.degrees(edges(spark, d))[1].groupBy("n_in").agg(F.count("*").alias("c"))
    upto = n.withColumn("hi", F.sum("c").over(Window.orderBy("n_in"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    t = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.9,)], "t double")
    at = F.floor(F.col("t") * F.col("all"))
    hit = upto.join(F.broadcast(t.filter("t > 0")), (at < F.col("hi")) & (at >= F.col("hi") - F.col("c"))).select("t", F.round(F.col("n_in") + 1e-6, 6).alias("cutoff"))
    return hit.unionByName(t.filter("t <= 0").withColumn("cutoff", F.lit(0.0)))


@query(f"WITH {EDGES}, s AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1) SELECT node, CASE WHEN n <= 5 THEN 0.0 ELSE round(least(0.99, 1 - 5.0 / n), 6) END::DOUBLE AS threshold FROM s")
def d21_auto_threshold(spark: SparkSession, d: str) -> DataFrame:
    n = G.degrees(edges(spark, d))[0]
    return n.select("node", F.when(F.col("n_out") <= 5, 0.0).otherwise(F.round(F.least(F.lit(0.99), 1 - 5.0 / F.col("n_out")), 6)).alias("threshold"))


@query(f"WITH {PAPERS}, x AS (SELECT *, max(ln(1 + cited)) OVER () AS top, row_number() OVER (ORDER BY date, node) - 1 AS i, count(*) OVER () AS n FROM papers) SELECT node, round(0.45 * ln(1 + cited) / top + 0.55 * (1 - i::DOUBLE / (n - 1)), 4) AS weight FROM x")
def d22_importance_weight(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.corpus import dense_id

    p = papers(spark, d)
    top = p.agg(F.max(F.log1p("cited")).alias("top"), F.count("*").alias("n"))
    x = dense_id(p, ["date", "node"], "i").crossJoin(F.broadcast(top))  # one row
    return x.select("node", F.round(0.45 * F.log1p("cited") / F.col("top") + 0.55 * (1 - F.col("i") / (F.col("n") - 1)), 4).alias("weight"))


@query(f"WITH {PAPERS}, {EDGES} SELECT src AS node, dst AS partner, row_number() OVER (PARTITION BY src ORDER BY p.cited DESC, p.date DESC, dst)::INT AS rank FROM edges JOIN papers p ON p.node = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY p.cited DESC, p.date DESC, dst) <= 7")
def d23_d25_ranked_fan(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).join(papers(spark, d).select(F.col("node").alias("dst"), "cited", "date"), "dst")
    return G.top_per(e, ["src"], [F.desc("cited"), F.desc("date"), F.col("dst")], 7).select(F.col("src").alias("node"), F.col("dst").alias("partner"), "rank")


@query(f"WITH {EDGES}, pairs AS (SELECT v.vec_id AS a, w.vec_id AS b, round(list_dot_product(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 5) AS s FROM embeddings v JOIN embeddings w ON v.label = w.label AND v.vec_id <> w.vec_id) SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INT AS rank FROM pairs WHERE NOT EXISTS (SELECT 1 FROM edges WHERE (src = a AND dst = b) OR (src = b AND dst = a)) QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5")
def d24_similar_not_cited(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "label", F.col("embedding").alias("v"))
    return L.similar_not_cited_among(v, edges(spark, d), 5, "label")


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE xor(((src + 1) * 73856093) & 4294967295, ((dst + 1) * 19349663) & 4294967295) % 1000 < 50")
def d26_ambient_sample(spark: SparkSession, d: str) -> DataFrame:
    return G.ambient(edges(spark, d), 50)


@query(f"WITH {EDGES}, w AS (SELECT src AS a, dst AS b, (src % 10) / 10.0 AS w FROM edges UNION ALL SELECT dst, src, 0.45 FROM edges) SELECT least(a, b) AS a, greatest(a, b) AS b, max(w)::DOUBLE AS w FROM w WHERE a <> b AND w > 0 GROUP BY 1, 2")
def d27_fused_undirected(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.undirected(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("src") % 10 / 10).alias("w")).union(e.select("dst", "src", F.lit(0.45))))
