"""Operators on small literal tables."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import corpus as C
from skein.operators import graph as G
from skein.operators import orgs as O
from skein.operators import search as S
from skein.operators import vectors as VO
from skein.sources import readers as R
from skein.streaming import upsert as U


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_rebuild_text(spark):
    rows = [({"the": [0, 3], "cat": [1], "saw": [2], "dog": [6]},), ({},), (None,), ({"a": [0], "b": [0]},)]
    assert values(spark, T.rebuild_text(F.col("m")), rows, "m map<string,array<int>>") == ["the cat saw the dog", None, None, "b"]
    assert values(spark, T.rebuild_text(T.invert_words(F.split("s", " "))), [("x y x z",)], "s string") == ["x y x z"]


def test_identifiers(spark):
    one = lambda e, s: values(spark, e(F.col("s")), [(s,)], "s string")[0]
    assert one(T.clean_doi, "https://doi.org/10.1145/3641289") == "10.1145/3641289" and one(T.clean_doi, "") is None
    assert one(T.arxiv_of_doi, "10.48550/arXiv.2601.00001") == "2601.00001"
    assert str(one(T.arxiv_month, "9108.0001")) == "1991-08-01" and one(T.arxiv_month, "2499.00001") is None and str(one(T.arxiv_month, "hep-th/9901001")) == "1999-01-01"
    assert one(T.short_id, "https://openalex.org/W12//") == "W12" and one(T.numeric_id, "https://x/fields/17") == 17 and one(T.numeric_id, "x") == -1
    assert str(one(T.first_stamp_date, "Mon, 2 Apr 2007 19:18:42 GMT")) == "2007-04-02" and one(T.first_stamp_date, "soon") is None
    assert one(T.arxiv_in, "see https://arxiv.org/pdf/2401.01234v2.pdf") == "2401.01234"
    assert one(T.normal_title, "The {$\\alpha$}-Method: II") == "the alpha method ii"
    assert one(T.clean_markup, '<p class="x">A &amp; B</p> http://a.b/c') == "A B"


def test_months(spark):
    e = T.month_index(F.col("s"), 1991)
    assert values(spark, e, [("1991-01-05",), ("1992-13-01",), ("1990-05-01",)], "s string") == [0, 12, 0]


def test_change_log(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    log = spark.createDataFrame([(1, "a2", 1, False), (1, "a3", 2, False), (2, "", 3, True), (4, "d", 4, False), (4, "", 5, True), (5, "e", 6, False)], "id int, v string, pos int, gone boolean")
    got = C.apply_changes(base, log, "id", "pos", "gone", F.col("id") < 5).collect()
    assert sorted(map(tuple, got)) == [(1, "a3"), (3, "c")]


def test_dense_ids_and_first_seen(spark):
    df = spark.createDataFrame([(k * 7 % 100, k) for k in range(100)], "v int, pos int").repartition(6)
    got = C.dense_id(df, ["v"]).collect()
    assert all(r.node_id == r.v for r in got) and len(got) == 100
    twice = df.union(df.withColumn("pos", F.col("pos") + 500))
    assert {r.pos for r in C.first_seen(twice, "v", "pos").collect()} == set(range(100))
    assert C.dense_id(df.limit(0), ["v"]).collect() == []


def test_merge(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, a string").withColumn("n", F.lit(None)), spark.createDataFrame([(2, 5)], "id int, n int")
    out = C.merge_corpora(a, b, "id")
    assert dict(out.dtypes)["n"] == "int" and sorted(map(tuple, out.select("id", "a", "n").collect())) == [(1, "x", None), (2, None, 5)]
    with pytest.raises(ValueError):
        C.merge_corpora(a, a, "id")


def test_enrich_keeps_rows(spark):
    base = spark.createDataFrame([(1, ["a"], None), (2, ["b"], "d")], "id int, who array<string>, doi string")
    p = spark.createDataFrame([(1, [], "x"), (2, ["c"], "y")], "id int, who array<string>, doi string")
    assert sorted(map(tuple, C.enrich(base, p, "id", ["who"], ["doi"]).collect())) == [(1, ["a"], "x"), (2, ["c"], "d")]


def test_citation_scores_and_hub_cap(spark):
    e = spark.createDataFrame([(0, 1), (2, 1), (2, 3)], "src long, dst long")
    pairs = {(r.a, r.b): r for r in G.shared_neighbours(e).collect()}
    assert pairs[0, 2].refs == 1 and pairs[1, 3].citers == 1
    score = {(r.a, r.b): r.score for r in G.citation_scores(e, G.shared_neighbours(e)).collect()}
    assert score[0, 2] == 0.25 and score[1, 3] == 0.25
    hub = spark.createDataFrame([(k, 0) for k in range(1, 6)], "src long, dst long")
    at = lambda cap: {r.b for r in G.citation_candidates(hub, 10, cap).filter("a = 1").collect()}
    assert at(0) == {0, 2, 3, 4, 5} and at(3) == {0}


def test_projection_of_a_multimap(spark):
    lists = spark.createDataFrame([(10, [20, 30, 99]), (77, [20])], "key long, neighbors array<long>")
    ids = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 1)], "outside long, node_id long")
    assert sorted(map(tuple, G.project(lists, ids).collect())) == [(1, 2)]


def test_totals(spark):
    raw = spark.createDataFrame([(999, 101), (102, 101), (102, 998), (102, 101)], "src long, dst long")
    known = spark.createDataFrame([(101,), (102,), (103,)], "node long")
    got = {r.node: (r.incoming, r.outgoing, r.internal) for r in G.citation_totals(raw, known).collect()}
    assert got == {101: (3, 0, 1), 102: (0, 3, 0), 103: (0, 0, 0)}


def test_fused_neighbours(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.8, 0.6, 0.0])], "node long, v array<double>")
    text = spark.createDataFrame([(0, 2)], "a long, b long")
    cited = spark.createDataFrame([(0, 1, 1.0)], "a long, b long, score double")
    got = [(r.b, r.score, r.rank) for r in G.fused_neighbours(text, cited, v, 0.6, 2).orderBy("rank").collect()]
    assert got == [(2, 0.48, 1), (1, 0.4, 2)]


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],)]
    assert values(spark, V.unit(F.col("v")), rows, "v array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    pts = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)], "node long, v array<double>")
    got = VO.exact_neighbours(pts.filter("node = 3"), pts, 3).orderBy("rank").collect()
    assert [r.nbr for r in got] == [49, 48, 47]


def test_organisations(spark):
    t = spark.createDataFrame([(1, "FAIR, Meta AI"), (2, "fair play"), (3, "Meta Materials")], "id int, text string")
    assert sorted(map(tuple, O.first_unit(t, ["id"], [("FAIR", r"\bFAIR\b"), ("Meta AI", "(?i)meta ai")]).collect())) == [(1, "FAIR")]
    got = O.all_matches(t, ["id"], [("Meta", r"\bMeta\b", "Materials"), ("FAIR", r"\bFAIR\b", None)]).collect()
    assert sorted(map(tuple, got)) == [(1, "FAIR"), (1, "Meta")]


def test_search_rules(spark):
    docs = spark.createDataFrame([(k, f"graph model {k}" if k % 2 else "graph mining", k) for k in range(30)], "node long, title string, cited long")
    ix = S.postings(docs, 10)
    assert ix.filter("token = 'graph'").count() == 10 and ix.filter("token = 'graph' and not capped").count() == 0
    assert S.title_search(ix, "graph absentword", 5).collect() == []
    assert [r.node for r in S.title_search(ix, "zz graph 29", 5).collect()] == []
    assert [r.node for r in S.title_search(ix, "graph 29", 5).collect()] == [29]
    assert S.title_search(ix, "a", 5).collect() == []


def test_readers(spark, tmp_path):
    p = tmp_path / "w.jsonl"
    p.write_text(json.dumps({"id": "https://openalex.org/W1", "abstract_inverted_index": {"a": [0]}, "authorships": [{"author": {"id": "A1"}, "institutions": [{"id": "I1"}]}]}) + "\n\n{\"id\": \"cut")
    rows = R.read_records(spark, str(p), R.WORK).collect()
    assert len(rows) == 1 and rows[0].authorships[0].institutions[0].id == "I1"
    with pytest.raises(Exception):
        R.read_records(spark, str(p), R.WORK, strict=True).collect()
    c = tmp_path / "c.jsonl"
    c.write_text('{"citingcorpusid": 1, "citedCorpusId": 2}\n{"citingCorpusId": 3}\n{"citingCorpusId": 4, "citedcorpusid": 5, "isinfluential": true}\n')
    assert sorted((r.src, r.dst) for r in R.read_citations(spark, str(c)).collect()) == [(1, 2), (4, 5)]
    xml = "<record><header><identifier>oai:arXiv.org:2401.00001</identifier><datestamp>2024-01-02</datestamp></header><metadata><arXiv><id>2401.00001</id><title>T</title><abstract>A</abstract><categories>math.OC cs.LG</categories><created>2024-01-01</created></arXiv></metadata></record>"
    gone = '<record><header status="deleted"><identifier>oai:arXiv.org:2401.00002</identifier><datestamp>2024-01-03</datestamp></header></record>'
    got = {r.id: r for r in R.parse_oai(spark.createDataFrame([(xml,), (gone,)], "xml string")).collect()}
    assert got["2401.00001"].primary == "math.OC" and not got["2401.00001"].deleted and got["2401.00002"].deleted


def test_shards_and_manifest(spark, tmp_path):
    R.write_shards(spark.range(5000).withColumnRenamed("id", "node"), str(tmp_path / "s"), "node", 2048)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.filter("shard = 2").count() == 5000 - 4096
    assert R.manifest(spark, {"s": str(tmp_path / "s")}).first().files >= 3


def test_streamed_upsert(spark, tmp_path):
    t = U.KeyedTable(spark, str(tmp_path / "t"), "id")
    t.publish(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 1)
    schema = "id int, v string, pos int, gone boolean"
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a2", 1, False), (2, "", 2, True)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: U.upsert_stream(spark.readStream.schema(schema).parquet(src), t, str(tmp_path / "cp"), "pos", "gone").awaitTermination()
    stream()
    spark.createDataFrame([(3, "c", 3, False)], schema).coalesce(1).write.mode("append").parquet(src)
    stream()
    stream()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a2"), (3, "c")]


def test_windows_of_a_stream(spark, tmp_path):
    rows = [Row(user_id=1, ts=f"2024-01-01 00:{m:02d}:00", value=1.0) for m in range(0, 60, 10)] + [Row(user_id=1, ts="2024-01-01 05:00:00", value=2.0)]
    spark.createDataFrame(rows).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    q = U.windowed_counts(spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("skein_w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r.v) for r in spark.table("skein_w").collect()} == {(6, 6.0), (1, 2.0)}
