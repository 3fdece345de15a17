"""Corpus-construction queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import corpus as C
from skein.operators import lookups as L
from skein.operators import records as R
from skein.plans.registry import Registry
from skein.plans.tables import PAPERS, TITLES, papers, table, titles

query = Registry()

#: Identifiers made of a page's number, in the forms that records have.
_FORMS = "CASE page_id % 6 WHEN 0 THEN 'https://doi.org/10.1145/' || page_id WHEN 1 THEN '10.48550/arXiv.2401.' || lpad(page_id::VARCHAR, 5, '0') WHEN 2 THEN 'https://openalex.org/T' || page_id || '/' WHEN 3 THEN '' WHEN 4 THEN 'http://arxiv.org/abs/' || lpad((page_id % 100)::VARCHAR, 2, '0') || lpad((page_id % 14)::VARCHAR, 2, '0') || '.01234v3' ELSE ' doi.org/10.1/x/' || page_id END"


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    form = (F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("https://doi.org/10.1145/"), n)).when(F.col("page_id") % 6 == 1, F.concat(F.lit("10.48550/arXiv.2401."), F.lpad(n, 5, "0")))
            .when(F.col("page_id") % 6 == 2, F.concat(F.lit("https://openalex.org/T"), n, F.lit("/"))).when(F.col("page_id") % 6 == 3, "")
            .when(F.col("page_id") % 6 == 4, F.concat(F.lit("http://arxiv.org/abs/"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"), F.lit(".01234v3")))
            .otherwise(F.concat(F.lit(" doi.org/10.1/x/"), n)))
    return table(spark, d, "pages").select("page_id", form.alias("raw"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, event_type, value FROM events WHERE json_valid(props)")
def a1_a2_json_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return e.filter("p._corrupt_record is null").select("event_id", F.col("p.k").alias("k"), "event_type", "value")


@query("SELECT l_orderkey AS citing, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, l_suppkey) AS cited, l_linenumber AS citationid FROM lineitem WHERE coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, l_suppkey) IS NOT NULL")
def a6_a7_endpoint_names(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("citedcorpusid", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")))
    return li.select(F.col("l_orderkey").alias("citing"), F.coalesce("citedcorpusid", "l_suppkey").alias("cited"), F.col("l_linenumber").alias("citationid")).filter("citing is not null and cited is not null")


@query("SELECT o_custkey AS key, count(*)::BIGINT AS neighbors FROM orders GROUP BY 1")
def a10_list_lengths(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_orderkey").alias("n"))
    return R.list_lengths(lists, "key", "n")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def a15_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"WITH {PAPERS}, u AS (SELECT node, cited FROM papers WHERE year BETWEEN 1995 AND 1998 AND cited > 25 UNION SELECT node, cited FROM papers WHERE year >= 2000 AND cited > 2) SELECT node, cited FROM u ORDER BY cited DESC, node LIMIT 3000")
def a17_two_field_filters(spark: SparkSession, d: str) -> DataFrame:
    return C.two_field_filter(papers(spark, d), F.col("year"), F.col("cited"), 1995, 1998, 2000, 3000, "node").select("node", "cited")


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ')) AS md5 FROM documents WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 0")
def b1_rebuild_text(spark: SparkSession, d: str) -> DataFrame:
    """The index of each text is made from its words in order, inside its row, and rebuilt by the operator."""
    words = table(spark, d, "documents").select("doc_id", F.array_remove(F.split("text", r"[ \t-\r]+"), "").alias("words")).filter(F.size("words") > 0)
    index = words.select("doc_id", T.inverted(F.col("words")).alias("index"))
    return index.select("doc_id", F.md5(T.rebuild_text(F.col("index"))).alias("md5"))


@query(f"WITH {TITLES} SELECT doc_id, md5(CASE WHEN trim(title) = '' THEN source WHEN doc_id % 3 = 0 THEN trim(title) ELSE trim(title) || '. ' || source END) AS text FROM titles")
def b2_embed_text(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("doc_id", F.md5(T.embed_text(F.col("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")))).alias("text"))


@query(f"WITH x AS (SELECT page_id, {_FORMS} AS raw FROM pages), s AS (SELECT *, nullif(regexp_extract(raw, '([^/]+)/*$', 1), '') AS seg FROM x) SELECT page_id, seg AS short_id, coalesce(try_cast(regexp_replace(seg, '[^0-9]', '', 'g') AS INT), -1) AS number FROM s")
def b3_b4_short_and_numeric_id(spark: SparkSession, d: str) -> DataFrame:
    return identifiers(spark, d).select("page_id", T.short_id(F.col("raw")).alias("short_id"), T.numeric_id(F.col("raw")).alias("number"))


@query("SELECT n_nationkey AS topic_id, n_name AS topic, coalesce(CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END, -1) AS field_id, CASE WHEN n_nationkey % 4 > 0 THEN r_name END AS field FROM nation JOIN region ON n_regionkey = r_regionkey")
def b5_topic_lineage(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    entity = lambda kind, key, name: [F.concat(F.lit(f"https://x.org/{kind}/"), F.col(key)).alias("id"), F.col(name).alias("display_name")]
    field = F.when(F.col("n_nationkey") % 4 > 0, F.struct(*entity("fields", "n_regionkey", "r_name")))
    works = n.select(F.struct(*entity("T", "n_nationkey", "n_name"), field.alias("field")).alias("primary_topic"))
    return works.select(*R.topic_lineage("primary_topic", ("field",))).withColumn("topic_id", F.col("topic_id").cast("int"))


@query(f"WITH x AS (SELECT page_id, {_FORMS} AS raw FROM pages) SELECT page_id, nullif(regexp_replace(trim(raw), '^(https?://)?(dx\\.)?doi\\.org/', '', 'i'), '') AS doi, nullif(regexp_extract(lower(raw), 'arxiv\\.(.+)$', 1), '') AS arxiv FROM x")
def b6_b7_doi_and_arxiv(spark: SparkSession, d: str) -> DataFrame:
    return identifiers(spark, d).select("page_id", T.clean_doi(F.col("raw")).alias("doi"), T.arxiv_of_doi(F.col("raw")).alias("arxiv"))


@query("WITH x AS (SELECT page_id, lpad((page_id % 100)::VARCHAR, 2, '0') AS yy, page_id % 14 AS mm FROM pages) SELECT page_id, CASE WHEN mm BETWEEN 1 AND 12 THEN (CASE WHEN yy >= '91' THEN '19' ELSE '20' END || yy || '-' || lpad(mm::VARCHAR, 2, '0') || '-01') END AS month FROM x")
def b8_arxiv_month(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"), F.lit(".0001"))
    return table(spark, d, "pages").select("page_id", T.arxiv_month(code).cast("string").alias("month"))


@query("SELECT o_orderkey AS node, strftime(CASE WHEN date_trunc('month', o_orderdate) = make_date(year(o_orderdate), o_orderkey % 12 + 1, 1) THEN o_orderdate::DATE ELSE make_date(year(o_orderdate), o_orderkey % 12 + 1, 1) END, '%Y-%m-%d') AS date FROM orders")
def b9_prefer_month(spark: SparkSession, d: str) -> DataFrame:
    month = F.make_date(F.year("o_orderdate"), (F.col("o_orderkey") % 12 + 1).cast("int"), F.lit(1))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), T.prefer_month(F.to_date("o_orderdate"), month).cast("string").alias("date"))


@query("SELECT l_orderkey AS node, list_aggregate(list_sort(list(DISTINCT s_nationkey::INT)), 'string_agg', ',') AS orgs, count(DISTINCT l_suppkey)::BIGINT AS authors FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def b10_m2_parse_authorships(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    x = li.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("node").agg(F.array_sort(F.collect_set("s_nationkey")).alias("o"), F.count("*").alias("authors"))
    return x.select("node", F.array_join("o", ",").alias("orgs"), "authors")


@query("WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS first_type, min(event_id) AS first_id FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS node_id FROM f")
def b11_first_seen_dense_id(spark: SparkSession, d: str) -> DataFrame:
    first = C.first_seen(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return C.dense_id(first, ["user_id"]).select("user_id", F.col("event_type").alias("first_type"), F.col("event_id").alias("first_id"), "node_id")


@query("SELECT o_orderkey AS node, strftime(o_orderdate, '%Y-%m-%d') AS v1 FROM orders")
def b12_stamp_date(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.concat(F.lit("Xxx, "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" +0900"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), T.first_stamp_date(stamp).cast("string").alias("v1"))


@query("SELECT p_partkey AS id, p_type AS categories, coalesce(list_filter(string_split(p_type, ' '), lambda c: c[1:2] IN ('ST', 'EC', 'BR'))[1], string_split(p_type, ' ')[1]) AS primary_category, len(list_filter(string_split(p_type, ' '), lambda c: c[1:2] IN ('ST', 'EC', 'BR'))) > 0 AS in_scope FROM part")
def b13_b14_category_scope(spark: SparkSession, d: str) -> DataFrame:
    cats, prefixes = F.split("p_type", " "), ["ST", "EC", "BR"]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("categories"), R.primary_category(cats, [], prefixes).alias("primary_category"), (F.size(R.in_scope(cats, [], prefixes)) > 0).alias("in_scope"))


@query("SELECT c_custkey AS author, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'A. ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' Jr.' ELSE '' END END AS name, 'arxiv-name:' || sha1(regexp_replace(lower(c_name), '[^a-z0-9_]+', '', 'g'))[1:16] AS name_id FROM customer")
def b15_b16_author_names(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.when(F.col("c_custkey") % 5 != 0, c)
    name = T.person_name(part(F.col("c_mktsegment")), part(F.lit("A.")), part(F.when(F.col("c_custkey") % 2 == 0, "Jr.")), F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("author"), name.alias("name"), T.name_id(F.col("c_name")).alias("name_id"))


@query("WITH x AS (SELECT p_partkey, list_transform(range(1, length(p_type) + 1), lambda i: ascii(substr(p_type, i, 1))::BIGINT) AS bytes FROM part), c AS (SELECT p_partkey, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x % 2)))) AS crc FROM x) SELECT p_partkey, xor(crc, 4294967295) & 2147483647 AS topic_id FROM c")
def b17_topic_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.hash_id(F.col("p_type")).alias("topic_id"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS squeezed, contains(lower(text), 'the') AS mentions FROM documents")
def b18_squeeze_and_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("squeezed"), F.contains(F.lower("text"), F.lit("the")).alias("mentions"))


@query(f"WITH {PAPERS} SELECT node, date FROM papers WHERE date BETWEEN '1996-03-01' AND '1998-09-30'")
def b19_date_range(spark: SparkSession, d: str) -> DataFrame:
    return R.in_dates(papers(spark, d), "date", "1996-03-01", "1998-09-30").select("node", "date")


@query("WITH last AS (SELECT user_id AS id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v, max(event_id) AS e FROM events GROUP BY 1), base AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer) SELECT id, v FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, v FROM last WHERE t <> 'error' AND e % 7 <> 0")
def b20_change_log(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("value").alias("v"), "event_id", (F.col("event_type") == "error").alias("deleted"))
    return C.apply_changes(base, log, "id", "event_id", "deleted", F.col("event_id") % 7 != 0)


@query("SELECT c_custkey AS id, c_mktsegment AS evidence FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT DISTINCT o_custkey, '{}' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def b21_add_missing(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("evidence"))
    return C.add_missing(have, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", {"evidence": F.lit("{}")})


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS node_id FROM embeddings WHERE label % 3 > 0")
def b22_compact(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("node_id"))
    return C.compact(v, F.col("label") % 3 > 0, "vec_id").select("vec_id", "node_id")


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, NULL::BIGINT AS size FROM customer UNION ALL SELECT 1000000 + p_partkey, NULL, NULL, p_size::BIGINT FROM part")
def b23_b24_merge_corpora(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit(None).alias("size"))
    b = table(spark, d, "part").select((F.col("p_partkey") + 1000000).alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return C.merge_corpora(a, b, "id").select("id", "nation", "segment", "size")


@query("WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS nation, s_name AS name FROM supplier) SELECT c_custkey AS id, coalesce(p.nation, c_nationkey) AS nation, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE p.name END AS name FROM customer LEFT JOIN p ON p.id = c_custkey")
def b25_enrich(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("nation"), F.col("s_name").alias("name"))
    return C.enrich(base, p, "id", ["nation"], ["name"])


@query("SELECT l_orderkey AS id, l_partkey AS part, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'A') DESC, l_quantity DESC, l_linenumber DESC, l_partkey DESC) = 1")
def b26_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "A").alias("exact"), "l_quantity", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return C.best_candidate(li, "id", ["exact", "l_quantity", "line", "part"], ["part", "line"])


@query(f"WITH x AS (SELECT page_id, {_FORMS} AS raw FROM pages) SELECT page_id, lower(coalesce(nullif(regexp_extract(raw, 'arxiv\\.org/(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}})', 1), ''), nullif(regexp_extract(raw, '10\\.48550/arXiv\\.(\\d{{4}}\\.\\d{{4,5}})', 1), ''))) AS arxiv FROM x")
def b27_i20_arxiv_in_work(spark: SparkSession, d: str) -> DataFrame:
    return identifiers(spark, d).select("page_id", F.lower(T.arxiv_in(F.col("raw"))).alias("arxiv"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AS fresh FROM events")
def b28_fresh(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.fresh(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.to_timestamp(F.lit("2024-01-20 00:00:00")), 7).alias("fresh"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def b29_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_wins(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("WITH a AS (SELECT c_custkey AS id, 1 AS route, min('c' || c_nationkey) AS value FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1), b AS (SELECT s_suppkey AS id, 2 AS route, min('s' || s_nationkey) AS value FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM a) GROUP BY 1), c AS (SELECT p_partkey AS id, 3 AS route, min(p_brand) AS value FROM part WHERE p_partkey NOT IN (SELECT id FROM a UNION SELECT id FROM b) GROUP BY 1), w AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT id, route, value FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE id IN (SELECT id FROM w)")
def b30_route_cascade(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), "c_nationkey").alias("value"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_nationkey").alias("value"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    return C.route_cascade(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", [a, b, c])


@query("SELECT p_brand AS key, arg_min(p_name, p_partkey) AS first_name, arg_max(p_name, p_partkey) AS last_name FROM part GROUP BY 1")
def b31_registry_merge(spark: SparkSession, d: str) -> DataFrame:
    return R.first_and_last(table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("name"), "p_partkey"), "key", "name", "p_partkey")


@query("SELECT o.o_orderkey AS node, c.c_acctbal AS column_value FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F'")
def b32_propagate(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("column_value"))
    full = o.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("k")).join(c, "k", "left").select("node", "column_value")
    active = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"), F.lit(0.0).alias("column_value"))
    return L.propagate(active, full, "node", ["column_value"])


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[{}$\\]', '', 'g'), '[^a-z0-9]+', ' ', 'g').trim() AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)")
def i20_m32_normal_title(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("doc_id", T.normal_title(F.col("title")).alias("title"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, 'https?://\S+|www\.\S+', ' ', 'g'), '\b[a-zA-Z-]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\b[a-zA-Z]+:[a-zA-Z]+\b', ' ', 'g'), '&[a-z]+;|&#\d+;', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS md5 FROM pages""")
def i15_clean_all_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.clean_markup(F.col("html"))).alias("md5"))


@query("SELECT p_partkey AS corpusid, p_name[1:6] AS title, coalesce(nullif(p_brand[1:5], 'Brand'), '') AS venue, coalesce(p_size, 0) AS cites FROM part WHERE p_partkey IS NOT NULL")
def m12_crosswalk_projection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("corpusid"), F.col("p_name").alias("title"), F.nullif(F.substring("p_brand", 1, 5), F.lit("Brand")).alias("venue"), F.col("p_size").alias("cites"))
    return R.crosswalk_rows(p, 6, 5).drop("arxiv_id")


@query("SELECT c_custkey AS id, round(c_acctbal)::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def m6_m7_wanted_only(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("id"))
    return L.wanted_only(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal").cast("bigint").alias("n")), wanted, "id", ["n"])


@query("SELECT n_regionkey AS org, list_aggregate(list_sort(list(DISTINCT s_suppkey)), 'string_agg', ',') AS ids FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def m11_flatten_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("org"))
    return R.flatten_ids(table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey"), "org", "s_suppkey")  # 25 nations


@query("SELECT label, sha256(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS key FROM embeddings GROUP BY 1")
def e8_m14_fingerprint_of_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.ids_fingerprint(table(spark, d, "embeddings"), "label", "vec_id")


def _works(spark: SparkSession, d: str) -> DataFrame:
    """Orders as works: an authorship for each different supplier, in order of its number, whose institution is its nation and whose affiliation string is its name; every 11th has no title."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    person = F.struct(F.concat(F.lit("https://x.org/A"), "s_suppkey").alias("id"), F.col("s_name").alias("display_name"))
    nation = F.array(F.struct(F.concat(F.lit("https://x.org/I"), "s_nationkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("display_name")))
    one = F.struct("s_suppkey", F.struct(person.alias("author"), nation.alias("institutions"), F.array(F.col("s_name")).alias("raw_affiliation_strings")).alias("x"))
    lists = li.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(one)), lambda y: y["x"]).alias("authorships"))
    title = F.when(F.col("node") % 11 > 0, F.concat(F.lit("t"), "node")).otherwise("")
    return lists.select(F.concat(F.lit("https://x.org/W"), "node").alias("id"), title.alias("title"), "authorships")


_WORKS = "a AS (SELECT DISTINCT l_orderkey AS node, s_suppkey, s_name, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey % 11 > 0)"


@query(f"""WITH {_WORKS}, i AS (SELECT node, 'I' || s_nationkey AS inst, min(s_suppkey) AS k FROM a GROUP BY 1, 2), e AS (SELECT node, 'R' || n_regionkey AS org, string_agg(s_name, ';' ORDER BY s_suppkey) AS s FROM a JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 3 GROUP BY 1, 2)
SELECT 'W' || a.node AS id, 't' || a.node AS title, string_agg('A' || s_suppkey, ',' ORDER BY s_suppkey) AS authors, (SELECT string_agg(inst, ',' ORDER BY k) FROM i WHERE i.node = a.node) AS institutions, coalesce((SELECT string_agg(org || '=' || s, '|' ORDER BY org) FROM e WHERE e.node = a.node), '') AS evidence FROM a GROUP BY a.node""")
def b10_parse_work(spark: SparkSession, d: str) -> DataFrame:
    """Works in the shape of the records: those without a title go; institutions differ; an organisation's evidence comes from its own authorships alone."""
    orgs = table(spark, d, "nation").filter("n_regionkey < 3").select(F.concat(F.lit("I"), "n_nationkey").alias("institution"), F.concat(F.lit("R"), "n_regionkey").alias("org"))
    w = R.parse_work(_works(spark, d), orgs)
    proof = F.array_join(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))), "|")
    return w.select("id", "title", F.array_join("author_ids", ",").alias("authors"), F.array_join("institution_ids", ",").alias("institutions"), proof.alias("evidence"))


@query("WITH a AS (SELECT DISTINCT l_orderkey AS node, s_nationkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT 'R' || n_regionkey AS org, CASE WHEN s_name LIKE '%1' THEN 'one' WHEN s_name LIKE '%2' THEN 'two' ELSE 'other' END AS unit, count(DISTINCT node)::BIGINT AS papers FROM a JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2")
def m2_unit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as JSON, read again; a string counts for the first unit of its organisation that it fits."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("R"), "n_regionkey").alias("org"))
    s = table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "org")  # 25 nations
    lists = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), "l_suppkey").distinct().join(s, "l_suppkey").groupBy("node", "org").agg(F.array_sort(F.collect_set("s_name")).alias("s"))
    papers_ = lists.groupBy("node").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("org", "s")))).alias("evidence"))
    units = {f"R{k}": [("one", "1$"), ("two", "2$"), ("other", ".")] for k in range(5)}
    return R.unit_evidence(papers_, units).groupBy("org", "unit").agg(F.count("*").alias("papers"))


@query(f"WITH {_WORKS}, p AS (SELECT node, 'A' || s_suppkey AS a, s_suppkey AS k FROM a), x AS (SELECT node, string_agg(a, ',' ORDER BY k) AS authors FROM p GROUP BY 1) SELECT 'W' || node AS id, authors FROM x")
def m8_provider_authors(spark: SparkSession, d: str) -> DataFrame:
    w = _works(spark, d).filter("title <> ''").withColumn("id", T.short_id(F.col("id")))
    return R.provider_authors(w.withColumn("authorships", F.concat("authorships", F.reverse("authorships")))).select("id", F.array_join("author_ids", ",").alias("authors"))


@query("WITH a AS (SELECT s_nationkey AS key, min(s_name) AS name FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS key, min(c_name) AS name FROM customer WHERE c_nationkey < 12 GROUP BY 1) SELECT coalesce(b.key, a.key) AS key, coalesce(b.name, a.name) AS last_wins, coalesce(a.name, b.name) AS first_wins FROM a FULL JOIN b ON a.key = b.key")
def b31_merge_registries(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("name"))
    b = table(spark, d, "customer").filter("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("name"))
    return R.merge_registries([a, b], "key").select("key", F.col("name").alias("last_wins")).join(R.merge_registries([a, b], "key", last_wins=False).select("key", F.col("name").alias("first_wins")), "key")


@query("WITH m AS (SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer) SELECT c.id, coalesce(c.nation, m.nation) AS nation, (SELECT round(count(*) FILTER (WHERE id IN (SELECT id FROM m))::DOUBLE / count(*), 6) FROM c) AS share FROM c LEFT JOIN m USING (id) WHERE c.id % 3 = 0")
def m9_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the corpus alone enrich it, the active subset takes the columns over, and the coverage is told."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_nationkey")).alias("nation"))
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    _, active, meta = R.enrichment(c, c.filter("id % 3 = 0"), m, "id", [], ["nation"])
    return active.crossJoin(F.broadcast(meta.select("share")))  # one row
