"""The pipeline's stages, each on its predecessor's result, against brute force."""

import glob
import os
from collections import Counter

import pytest

import corpus_pipeline as P
from skein.llm import mixing, substring_dedup
from tests.llm.test_ngram_join import brute

DIR = "/root/testdata/sf0.001"
MODEL = next(iter(glob.glob("/opt/tokenizers/piece_bpe_32k.model")), None)
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR) or MODEL is None, reason="no tables or model")


def test_stages(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, kept[-1], DIR).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [d.collect() for d in kept]
    assert all(d.columns == columns for d in kept[:-1])
    texts = [{r.doc_id: r.text for r in x} for x in rows[:-1]]

    assert texts[1].items() <= texts[0].items() and len(texts[1]) >= 0.95 * len(texts[0])

    one = sorted(d for d, _, c in brute([(r.doc_id, r.text) for r in rows[1]], 5, 80) if d == c)
    assert sorted(texts[2]) == one and texts[2].items() <= texts[1].items()

    words = {d: (t or "").split() for d, t in texts[2].items()}
    where = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(x.lower() for x in w[i : i + 50]), set()).add(d)
    shared = set().union(*[v for v in where.values() if len(v) > 1], set())
    changed, spans = {d for d in texts[2] if texts[3].get(d) != texts[2][d]}, {}
    for r in substring_dedup.report(kept[2]).collect():  # every cut is a passage that another text has, and nothing else goes
        x, y = words[r.doc_id][r.begin : r.end], words[r.first_doc_id][r.first_begin : r.first_end]
        gx, gy = ({tuple(t.lower() for t in z[i : i + 5]) for i in range(len(z) - 4)} for z in (x, y))
        assert min(len(x), len(y)) >= 50 and len(gx & gy) >= 0.8 * len(gx | gy) - 1e-9 and r.doc_id != r.first_doc_id
        spans.setdefault(r.doc_id, set()).update(range(r.begin, r.end))
    assert changed == set(spans)
    for d, gone in spans.items():
        assert (texts[3].get(d) or "").split() == [x for k, x in enumerate(words[d]) if k not in gone]
    assert len(shared - changed) <= len(shared) / 2
    again = Counter(x for d, t in texts[3].items() for x in {tuple(x.lower() for x in (t or "").split()[i : i + 60]) for i in range(len((t or "").split()) - 59)})
    assert max(again.values(), default=0) <= 1
    assert all(r.n_chars == len(r.text or "") for r in rows[3])

    want = Counter()
    for r in mixing.copies(kept[3]).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in rows[4]) == Counter({k: v for k, v in want.items() if v})

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows[5]) == Counter((r.doc_id, tuple(lib.encode(r.text or ""))) for r in rows[4])


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, DIR)
    assert out.columns == ["doc_id", "lang", "source", "ids"] and out.count() > 0


def test_extra_columns_with_the_operators_own_names(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    names = ["node", "row", "h", "n", "g", "b", "key", "id", "size", "copies", "score", "rejected", "lang_pred", "spans", "had", "first", "_d", "_n", "component_id", "target", "sid"]
    wide = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    nulls = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, 0)], docs.schema).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    wide.unionByName(nulls).write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, wide, DIR)
        assert out.columns == wide.columns
        assert all(r[c] == k for r in out.collect() for k, c in enumerate(names))
        assert stage(spark, wide.limit(0), DIR).collect() == []
    assert P.STAGES[-1][1](spark, wide, DIR).count() == wide.count()
