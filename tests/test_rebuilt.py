"""Indexes of texts made inside their rows."""

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.plans import corpus_queries as C
from tests.test_blocks import plan


def test_index_of_a_long_text(spark):
    texts = ["b a b", "", None, "one", " ".join(f"w{k * k % 997}" for k in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").withColumn("w", F.array_remove(F.split("s", " "), ""))
    got = {r.id: r.m for r in df.select("id", T.inverted(F.col("w")).alias("m")).collect()}
    for k, t in enumerate(texts):
        want = {}
        for i, w in enumerate((t or "").split()):
            want.setdefault(w, []).append(i)
        assert (got[k] or {}) == want


def test_texts_are_rebuilt_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b\ta  a\n"), (2, " \n"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = C.query.queries["b1_rebuild_text"](spark, str(tmp_path))
    assert "Exchange" not in plan(df)
    assert df.collect() == spark.sql("select 1L doc_id, md5('a b a a') md5").collect()
