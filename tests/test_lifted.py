"""Operators on literals and against sequential statements of the same rule."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import answers as A
from skein.operators import client as CL
from skein.operators import labels as LB
from skein.operators import lookups as L
from skein.operators import orgs as O
from skein.operators import records as R
from skein.operators import shards as SH
from skein.operators import stats as ST
from skein.plans import filters as V
from skein.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_claims_in_time(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "x")], "node int, author string")
    claims = spark.createDataFrame([("o", "x", "2024-01-01", "2024-12-31"), ("p", "y", None, None), ("q", "y", "2020-01-01", None)], "org string, author string, valid_from string, valid_to string")
    p = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-12-31"), (3, "2025-01-01"), (4, None), (5, None)], "node int, date string")
    assert rows(L.claims_in_time(a, claims, p).select("org", "node")) == [("o", 1), ("o", 2), ("p", 4)]


def test_nearest_in_time_against_all_pairs(spark):
    r = random.Random(4)
    data = [(r.randrange(12), n, r.randrange(40), "vw"[n % 2]) for n in range(200)]
    df = spark.createDataFrame(data, "key long, node long, day long, value string")
    got = {x.node: (x.nearest, x.gap, x.value) for x in L.nearest_in_time(df, value="value").collect()}
    for key, node, day, _ in data:
        near = min(((abs(day - d), n, v) for k, n, d, v in data if k == key and n != node), default=None)
        assert got.get(node) == (near and (near[1], near[0], near[2]))


def test_closure_ends_at_roots_unknown_parents_and_cycles(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, parent long")
    got = rows(L.ancestors(tree, 4))
    assert [x for x in got if x[0] <= 4] == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (3, 3, 0), (4, 4, 0)] and len([x for x in got if x[0] == 5]) == 5


def test_checks_of_propagation_and_bundles(spark):
    full = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    assert rows(L.propagate(spark.createDataFrame([(2, "old")], "id int, c string"), full, "id", ["c"])) == [(2, "b")]
    for active, f in (([(3, "")], full), ([(1, "")], full.union(full))):
        with pytest.raises(ValueError):
            L.propagate(spark.createDataFrame(active, "id int, c string"), f, "id", ["c"])
    p, e = spark.createDataFrame([(0,), (1,), (3,)], "node long"), spark.createDataFrame([(0, 1), (0, 7), (9, 1)], "src long, dst long")
    assert rows(L.bundle_violations(p, e, {"titles": p.limit(2)}, 1, 2)) == [("edge begin unknown", 1), ("edge end unknown", 1), ("ids not dense", 1), ("ids repeated", 0), ("schema version", 1), ("titles: other number of rows", 1)]
    assert rows(L.wanted_only(spark.createDataFrame([(1, "7"), (2, "x"), (3, "9")], "id int, n string"), spark.createDataFrame([(1,), (2,)], "id int"), "id", ["n"])) == [(1, 7)]


def test_provider_counts_and_references(spark):
    p = spark.createDataFrame([(0, 5), (1, 9)], "node long, cited long")
    given = spark.createDataFrame([(0, 40)], "node long, n long")
    assert rows(L.provider_materialise(p, given, False).select("node", "cited")) == [(0, 40), (1, 9)] and rows(L.provider_materialise(p, given, True).select("node", "cited")) == [(0, 5), (1, 9)]
    flags = spark.createDataFrame([(0, True), (1, None), (2, False), (3, None)], "node long, flag boolean")
    n = spark.createDataFrame([(0, 7), (1, 5), (2, 3)], "node long, n long")
    assert rows(L.reference_counts(flags, n)) == [(0, True, 7), (1, True, 5), (2, False, -1), (3, False, -1)]
    refs = spark.createDataFrame([(1, "W1"), (1, "W1"), (1, "W9")], "node int, provider string")
    papers = spark.createDataFrame([("W1", 0, "a"), ("W1", 1, "b")], "provider string, position int, paper string")
    assert rows(L.provider_references(refs, papers)) == [(1, "a", 1)]
    assert rows(L.attach_counts(p, None)) == [(0, 5, 0), (1, 9, 0)]


def test_works(spark):
    w = [("https://x/W1", "t", [(("https://x/A1", "Ann"), [("https://x/I1", "")], ["Lab, U1"]), (("https://x/A2", "Bo"), [("https://x/I2", ""), ("https://x/I1", "")], ["Inst 2"])]), ("https://x/W2", "", []), (None, "t", []), ("https://x/W4", "u", None)]
    df = spark.createDataFrame(w, "id string, title string, authorships array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<id:string,display_name:string>>,raw_affiliation_strings:array<string>>>")
    orgs = spark.createDataFrame([("I1", "one"), ("I2", "two")], "institution string, org string")
    got = {r.id: r for r in R.parse_work(df, orgs).collect()}
    assert set(got) == {"W1", "W4"} and got["W1"].institution_ids == ["I1", "I2"] and got["W1"].evidence == {"one": ["Lab, U1", "Inst 2"], "two": ["Inst 2"]} and got["W4"].evidence == {} and got["W4"].author_ids == []
    e = spark.createDataFrame([(1, json.dumps({"one": ["AI Lab, X", "X"], "two": ["AI Lab"]}))], "node int, evidence string")
    assert rows(R.unit_evidence(e, {"one": [("lab", "AI Lab"), ("any", "X")]})) == [("one", "any", 1), ("one", "lab", 1)]
    dup = spark.createDataFrame([("r", [(("A1", "Ann"), [("I1", "")], ["s"]), (("A1", "Anne"), [("I1", "")], ["t"])])], "id string, authorships array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<id:string,display_name:string>>,raw_affiliation_strings:array<string>>>")
    one = R.provider_authors(dup).first()
    assert one.author_ids == ["A1"] and one.author_names == ["Ann"] and json.loads(one.evidence) == {"I1": ["s", "t"]}
    cats = spark.createDataFrame([("math.OC cs.LG",), ("x",), ("stat.ML cs.AI",)], "c string").select(R.primary_category(F.split("c", " "), ["stat.ML"], ["cs."]).alias("p"), F.size(R.in_scope(F.split("c", " "), [], [""])).alias("n"))
    assert rows(cats) == [("cs.LG", 2), ("stat.ML", 2), ("x", 1)]


def test_organisations(spark):
    org = spark.createDataFrame([("a",)], "key string")
    claims = spark.createDataFrame([("r", 1, "registry"), ("r", 1, "coauthorship"), ("r", 2, "registry")], "org string, node int, method string")
    table = O.name_only_table(spark, [("a", "A", "lab"), ("n", "N", "lab"), ("z", "Z", "lab")])
    named = spark.createDataFrame([("a", 1), ("n", 2), ("n", 3)], "org string, node int")
    assert rows(O.roster_orgs(org, spark.createDataFrame([("r",), ("s",)], "key string"), claims)) == [("r", 2, ["coauthorship", "registry"]), ("s", 0, [])]
    with pytest.raises(ValueError):
        O.roster_orgs(org, org, claims)
    with pytest.raises(ValueError):
        O.name_only_table(spark, [("a", "A", ""), ("a", "B", "")])
    assert rows(O.named_orgs(org, table, named)) == [("n", 2, ["affiliation_name"])]
    inst = spark.createDataFrame([("I1", 1), ("I2", 1), ("I2", 2), ("I2", 3), ("I3", 1)], "institution string, node int")
    reg = spark.createDataFrame([("I2", "Two", "company"), ("I1", "One", "x")], "institution string, display_name string, type string")
    assert rows(O.directory(inst, spark.createDataFrame([("I1",)], "institution string"), reg)) == [("oa:I2", "Two", "company", 3)]
    assert rows(O.node_labels(inst, reg, named, table.select("key", "display_name"))) == [(1, "A"), (1, "One"), (1, "Two"), (2, "N"), (2, "Two"), (3, "N"), (3, "Two")]
    tree = spark.createDataFrame([(1, None, "r", "university"), (2, 1, "b", "lab"), (3, 1, "a", "school"), (4, 4, "loop", "lab")], "id int, parent int, name string, unit_type string")
    assert [(x.path, x.place) for x in O.org_tree(tree, ["university", "lab", "school"]).orderBy("depth", "place").collect()] == [("r", 1), ("r/b", 1), ("r/a", 2)]
    build = O.org_builder(inst, named, spark.createDataFrame([("a", "I1")], "key string, institution string"), reg, spark.createDataFrame([("r",)], "key string"), claims, table)
    assert rows(build.select("key", "kind", "papers")) == [("a", "curated", 1), ("n", "name", 2), ("oa:I2", "directory" if False else "company", 3), ("r", "roster", 2)]


def test_medians_quantiles_and_summaries(spark):
    r = random.Random(2)
    data = [(r.randrange(3), r.randrange(9)) for _ in range(101)] + [(7, 4), (7, 5)]
    df = spark.createDataFrame(data, "level int, cited int")
    import statistics

    assert {x.level: x.middle for x in ST.level_stats(df).collect()} == {k: statistics.median([c for lv, c in data if lv == k]) for k in {lv for lv, _ in data}}
    import numpy as np

    for q in (0.0, 0.3, 0.99, 1.0):
        assert abs(ST.exact_quantile(df, "cited", q).first().q - np.quantile([c for _, c in data], q)) < 1e-9
    assert ST.exact_quantile(df.limit(0), "cited", 0.5).first().q is None
    s = ST.summary(df, "level", "cited", {"p": 0.9})
    assert all(abs(x.p - np.quantile([c for lv, c in data if lv == x.level], 0.9)) < 1e-4 for x in s.collect())


def test_answers(spark):
    q = spark.createDataFrame([(1, 0.9, "A [1]. B."), (2, 0.5, "x"), (3, None, "x")], "id int, top1 double, answer string")
    got = rows(A.citations(A.gate(q), 3).select("id", "refused", "cited", "valid", "uncited_sentences"))
    assert got == [(1, False, 1, 1, 1), (2, True, None, None, None), (3, True, None, None, None)]
    assert tuple(A.validity(A.citations(A.gate(q), 3)).first()) == (1, 2, 1.0)


def test_declutter_as_one_pass_in_order(spark):
    r = random.Random(7)
    data = [(i, r.choice(["AI", "Graphs", "Vision", "Optics", f"t{i}"]), r.random() * 900, r.random() * 500, float(r.choice([10, 14])), float(r.randrange(40))) for i in range(150)]
    df = spark.createDataFrame(data, "id int, text string, px double, py double, size double, priority double")
    placed, texts, want = [], set(), set()
    for i, t, x, y, size, _ in sorted(data, key=lambda v: (-v[5], v[0])):
        w, h = len(t) * size * 0.6 / 2 + 6, size / 2 + 6
        b = (x - w, y - h, x + w, y + h)
        if t in texts or b[0] < 0 or b[1] < 0 or b[2] > 900 or b[3] > 500 or any(b[0] < o[2] and b[2] > o[0] and b[1] < o[3] and b[3] > o[1] for o in placed):
            continue
        placed.append(b)
        texts.add(t)
        want.add(i)
    assert {x.id for x in CL.declutter(df, 900.0, 500.0).collect()} == want


def test_lists_and_boxes(spark):
    p = spark.createDataFrame([(1, 5, 2020, "x"), (2, 9, 2019, ""), (3, 5, 2021, None)], "node int, cited int, year int, arxiv_id string")
    assert [x.node for x in CL.result_list(p, order="newest").collect()] == [3, 1, 2] and [x.node for x in CL.result_list(p, most=1).collect()] == [2] and [x.node for x in CL.figure_queue(p, 5).collect()] == [1]
    assert rows(CL.compare_counts(CL.compare_sets(p, p.filter("node < 3"), p.filter("node > 1")))) == [(2, 2, 1)]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 50.0), (1, 2, 0.0, 60.0, 100.0, 80.0), (1, 3, 0.0, 120.0, 90.0, 160.0), (1, 4, 300.0, 0.0, 400.0, 90.0), (1, 5, 0.0, 85.0, 30.0, 95.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    caps = spark.createDataFrame([(1, 1, False, 0.0, 100.0, 80.0, 110.0), (1, 2, True, 0.0, 100.0, 80.0, 110.0)], "page int, caption int, is_table boolean, x0 double, y0 double, x1 double, y1 double")
    assert rows(CL.box_choice(boxes, caps)) == [(1, 1, 1), (1, 2, 3)]
    assert rows(CL.recency(p)) == [(1, 0.5), (2, 0.0), (3, 1.0)]


def test_labels_from_the_top_down(spark):
    cells = [(1, None, 0, 50, ["Graph Learning"], ["node embedding"], None), (2, 1, 1, 30, ["Graph Learning"], ["node embedding", "link prediction"], None), (3, 1, 1, 20, ["Graph Learning"], ["link prediction"], None), (4, 3, 2, 2, [], [], None), (5, 3, 2, 9, ["Graph Learning"], [], "shared title words")]
    df = spark.createDataFrame(cells, "cell int, parent int, band int, n int, topics array<string>, phrases array<string>, leaf string")
    got = {r.cell: r.label for r in LB.choose_labels(df, 3).collect()}
    assert got[1] == "Graph Learning: node embedding" and got[2] == "Graph Learning: link prediction" and got[4] is None and got[5] == "shared title words"
    assert got[3] == "link prediction"  # all of its candidates repeat its sibling or its parent
    d = spark.createDataFrame([("gnn for llms",), ("deep deep nets",), ("",)], "p string").select(LB.display_phrase(F.col("p")).alias("d"), LB.good_phrase(F.col("p")).alias("g"))
    assert [tuple(x) for x in d.collect()] == [("GNN For LLMs", True), ("Deep Deep Nets", False), ("", False)]
    pairs = LB.redundant_pairs(spark.createDataFrame([(1, "a b c"), (2, "C B A"), (3, "a b"), (4, "x"), (5, "!!")], "id int, text string"))
    assert rows(pairs) == [(1, 2), (1, 3), (2, 3)]
    t = spark.createDataFrame([("s", 1, "Attention is all you need", 3), ("s", 2, "attention is all we had", 9), ("q", 3, "one single title", 0)], "set string, node int, title string, cited int")
    assert rows(LB.shared_phrase(t)) == [("q", "one single title", 1), ("s", "attention is all", 2)]


def test_markup_and_captions(spark):
    raw = ["see www.a.b/c and <b class='x y'>bold</b> &amp; mml:mi stretchy=false", 'a <mml:mo stretchy="false"'] 
    got = [x.t for x in spark.createDataFrame([(x,) for x in raw], "c string").select(T.clean_markup(F.col("c")).alias("t")).collect()]
    assert got == ["see and bold", "a <mml:mo"] or got == ["see and bold", "a <"] or all("stretchy" not in x and "www" not in x for x in got)
    lines = {"Figure 1: x": True, "Fig. 1. y": True, "Figure 1 shows": True, "Figure 10: x": False, "Table 1": True, "Table 1:": False, "Table 1: x": True, "Table 1 reports": False, "Table 1.2. x": True, "see Figure 1": False}
    assert {x.c: x.k for x in spark.createDataFrame([(k,) for k in lines], "c string").select("c", T.first_caption(F.col("c")).alias("k")).collect()} == lines


def test_views():
    v = V.set_compare_side({"org": ["a"], "author": [1], "topic": [3], "paper": 5}, "a", "x")
    assert v["org"] == ["a"] and V.compare_with(v, "y") == {"topic": [3], "compare": {"a": "x", "b": "y"}}
    assert V.select_paper({"org": ["a"], "cites": (1, 2)}, 7) == {"cites": (1, 2), "paper": 7} and V.select_paper({"org": ["a"], "paper": 7}, None) == {"org": ["a"]}


def test_files_for_clients(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (0, "b")], "node int, t string")
    sinks.write_arrow(df, f"{tmp_path}/x/a.arrow", ["node"])
    assert [tuple(r) for r in sinks.read_arrow(spark, f"{tmp_path}/x/a.arrow").collect()] == [(0, "b"), (1, "é")]
    sinks.write_json(df.filter("node = 1"), f"{tmp_path}/j.json")
    assert open(f"{tmp_path}/j.json", encoding="utf-8").read() == '[{"node":1,"t":"é"}]' and sinks.read_json(f"{tmp_path}/j.json") == [{"node": 1, "t": "é"}]
    sinks.write_npy(spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "node int, v array<double>"), f"{tmp_path}/v.npy", "v", "node")
    assert [r.v for r in sinks.read_npy(spark, f"{tmp_path}/v.npy").orderBy("node").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(ValueError):
        sinks.write_arrow(df, f"{tmp_path}/b.arrow", ["node"], most=1)
    df.write.parquet(f"{tmp_path}/t")
    assert sinks.load_bundle(spark, {"t": f"{tmp_path}/t"}, "bundle_")["t"].count() == spark.table("bundle_t").count() == 2 and sinks.shard_name("points", 4096, 2048) == "points-2"


def test_reading_list_export(spark):
    col = spark.createDataFrame([(1, None, "Done"), (2, 1, "Robots"), (3, None, "Other")], "id int, parent int, name string")
    mem = spark.createDataFrame([(1, 10), (2, 11), (2, 12), (3, 13), (2, 14)], "collection int, item int")
    items = spark.createDataFrame([(10, None, "journalArticle"), (11, None, "preprint"), (12, 11, "attachment"), (13, None, "preprint"), (14, None, "preprint")], "item int, parent int, type string")
    assert rows(sinks.library_items(col, mem, spark.createDataFrame([(14,)], "item int"), items, ["Done"])) == [("Done", 10), ("Done", 11)]
    raw = spark.createDataFrame([("k", "journalArticle", "2024-05-01T00:00:00", " T ", "2023-04", "10.1/x", "https://arxiv.org/abs/2401.00001v2", "", "", [("L", "F")], ["tag"])], "id string, type string, added string, title string, date string, doi string, url string, venue string, extra string, creators array<struct<family:string,given:string>>, tags array<string>")
    c = json.loads(sinks.csl_items(raw).first().csl)
    assert c["type"] == "article-journal" and c["issued"] == {"date-parts": [[2023, 4]]} and c["title"] == "T" and c["custom"] == {"added": "2024-05-01", "arxiv_id": "2401.00001", "tags": ["tag"]} and "container-title" not in c
    lists = sinks.csl_items(raw).select(F.explode(F.array(F.lit("b"), F.lit("a"))).alias("list"), "id", "csl")
    e = sinks.csl_envelope(lists, ["a", "b"], "list", "2024-01-01T00:00:00Z")
    assert [x["custom"]["list"] for x in e["items"]] == ["a"] and e["lists"] == [{"name": "a", "count": 1}, {"name": "b", "count": 0}]


def test_row_aligned_tables(spark):
    corpus = spark.createDataFrame([(0, "p0", "t", "2024-01-01", "", "2401.1", "v", 3, 7, None, ["n"], 2024, None), (1, "p1", "u", None, "d", None, "", 0, -1, [4], [], 2023, True)], "node_id long, paper_id string, title string, publication_date string, doi string, arxiv_id string, venue string, cited_by_count long, topic_id long, author_ids array<int>, author_names array<string>, year int, available boolean")
    p = {r.node_id: r for r in sinks.papers_table(corpus).collect()}
    assert p[0].doi is None and p[0].author_ids == [] and p[1].venue is None and p[1].author_ids == [4]
    floor = spark.createDataFrame([(0, 5, True), (1, 2, False)], "node long, cited_by long, enumerable boolean")
    refs = spark.createDataFrame([(0, True)], "node long, available boolean")
    assert rows(sinks.papers_index(corpus, floor, refs, spark.createDataFrame([(1,)], "node long"))) == [(0, 5, 2024, True, True, False), (1, 2, 2023, True, False, True)]
    assert {r.node_id: r.reference_count for r in sinks.paper_detail(corpus, spark.createDataFrame([(0, 9)], "node long, reference_count long")).collect()} == {0: 9, 1: -1}


def test_harvest_pages(spark):
    page = '<OAI-PMH><ListRecords><record><header><identifier>oai:arXiv.org:2401.00001</identifier><datestamp>2024-01-02</datestamp></header><metadata><arXiv><id>2401.00001</id><title>T</title><categories>math.OC cs.LG</categories></arXiv></metadata></record><record><header status="deleted"><identifier>oai:arXiv.org:2401.00002</identifier><datestamp>2024-01-03</datestamp></header></record><resumptionToken cursor="0">next</resumptionToken></ListRecords></OAI-PMH>'
    bad, none = '<OAI-PMH><error code="badArgument">no</error></OAI-PMH>', '<OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>'
    records, state = readers.parse_oai_page(spark.createDataFrame([(page,), (bad,), (none,)], "xml string"))
    assert rows(records.select("id", "deleted", "primary")) == [("2401.00001", False, "math.OC"), ("2401.00002", True, None)]
    assert rows(state) == [("next", None), (None, "badArgument: no"), (None, None)] or set(map(tuple, state.collect())) == {("next", None), (None, "badArgument: no"), (None, None)}


def test_shards(spark):
    pairs = spark.createDataFrame([(5, 1, 0.5), (5, -1, 0.0), (5, 2, 0.9)], "node long, nbr long, score double")
    assert rows(SH.neighbour_table(pairs, 5)) == [(5, [2, 1], [0.9, 0.5])]
    a = spark.createDataFrame([(0, "A1"), (130_000, "arxiv-name:x")], "author_id long, id string")
    assert rows(SH.author_chunks(a)) == [(0, "A1", 0, True), (130_000, "arxiv-name:x", 1, False)]


def test_hash_of_topics(spark):
    import zlib

    words = ["cs.LG", "math.OC", "", "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.hash_id(F.col("w")).alias("h")).collect()
    assert [x.h for x in got] == [zlib.crc32(w.encode()) & 0x7FFFFFFF for w in words]
