"""Streams with keyed state, running sums and paged harvests, stopped and started again."""

import glob
import os

from pyspark.sql import functions as F

from skein.sources.paged import PagedHarvest, page_name
from skein.sources.readers import parse_oai_page
from skein.streaming import state as S
from skein.streaming.upsert import KeyedTable

CHANGES = "id long, pos long, gone boolean, v string"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_latest_changes_survive_restarts_late_and_repeated_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        stream = S.latest_changes(spark.readStream.schema(CHANGES).parquet(src), "id", "pos", "gone")
        q = stream.writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(lambda df, b: df.withColumn("b", F.lit(b)).write.mode("append").parquet(out)).start()
        q.awaitTermination()
        return sorted((r.id, r.pos, r.gone, r.v) for r in spark.read.parquet(out).collect())

    try:
        put(spark, src, [(1, 5, False, "a"), (1, 7, False, "b"), (2, 1, False, "x"), (1, 7, False, "b")], CHANGES)
        assert run() == [(1, 7, False, "b"), (2, 1, False, "x")]
        put(spark, src, [(1, 6, False, "late"), (1, 7, False, "b"), (2, 3, True, None), (3, 1, False, "n")], CHANGES)  # late, repeated, deletion, new
        want = [(1, 7, False, "b"), (2, 1, False, "x"), (2, 3, True, None), (3, 1, False, "n")]
        assert run() == want
        put(spark, src, [(2, 2, False, "back from the dead"), (3, 9, False, "m")], CHANGES)  # older than the deletion
        assert run() == sorted([*want, (3, 9, False, "m")])
        assert run() == sorted([*want, (3, 9, False, "m")])  # nothing new
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_running_sums_once_a_batch(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    run = lambda: S.running_sums(spark.readStream.schema("k long, x long").parquet(src), table, cp, ["x"]).awaitTermination()
    put(spark, src, [(1, 10), (1, 5), (2, 1)], "k long, x long")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        table.publish(spark.createDataFrame([], "k long, n long, x long"), 1)
        run()
        assert {(r.k, r.n, r.x) for r in table.read().collect()} == {(1, 2, 15), (2, 1, 1)}
        put(spark, src, [(2, 4), (3, 7)], "k long, x long")
        run()
        want = {(1, 2, 15), (2, 2, 5), (3, 1, 7)}
        assert {(r.k, r.n, r.x) for r in table.read().collect()} == want
        last = max(int(os.path.basename(p)) for p in glob.glob(f"{cp}/commits/[0-9]*"))
        for p in (f"{cp}/commits/{last}", f"{cp}/commits/.{last}.crc"):
            os.remove(p)  # as if it had been killed before it said that the batch was done
        run()
        assert {(r.k, r.n, r.x) for r in table.read().collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def page(ids, token):
    records = "".join(f"<record><header><identifier>oai:x:{i}</identifier><datestamp>2024-01-02</datestamp></header><metadata><arXiv><id>{i}</id><title>T{i}</title><categories>math.OC</categories></arXiv></metadata></record>" for i in ids)
    return f'<OAI-PMH><ListRecords>{records}<resumptionToken cursor="0">{token or ""}</resumptionToken></ListRecords></OAI-PMH>'


def test_paged_harvest_resumes_at_its_token(spark, tmp_path):
    pages, out, cp = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "cp")
    pages.mkdir()
    spark.dataSource.register(PagedHarvest)
    save = lambda token, ids, following: (pages / page_name(token)).write_text(page(ids, following))

    def run():
        q = spark.readStream.format("paged_harvest").option("pages", "2").load(str(pages)).writeStream.option("checkpointLocation", cp).trigger(processingTime="0 seconds").foreachBatch(lambda df, b: parse_oai_page(df)[0].withColumn("b", F.lit(b)).write.mode("append").parquet(out) if not df.isEmpty() else None).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    save("first", [1, 2], "t|1/x")
    save("t|1/x", [3], "t|2")
    save("t|2", [4, 5], "t|3")
    assert run() == ["1", "2", "3", "4", "5"]
    save("t|3", [6], "t|4")
    save("t|4", [7], None)
    assert run() == ["1", "2", "3", "4", "5", "6", "7"]
    assert run() == ["1", "2", "3", "4", "5", "6", "7"]
