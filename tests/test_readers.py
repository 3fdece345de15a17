"""Broken records of shards, with their file and line."""

import gzip
import json

import pytest

from skein.sources import readers as R


def test_broken_lines_have_their_place(spark, tmp_path):
    good = [json.dumps({"id": f"W{k}", "title": "t" * (k % 50)}) for k in range(3000)]
    one, two = list(good), list(good)
    one[7] = '{"id": "W7", "title": '
    two[1], two[2500], two[2] = "not json", '{"id": "W2500"', ""
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(one) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(two) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several pieces of a file
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in R.broken_lines(spark, str(tmp_path)).collect()}
        assert got == {("a.jsonl.gz", 8, one[7]), ("b.jsonl", 2, "not json"), ("b.jsonl", 2501, two[2500])}
        assert R.read_records(spark, str(tmp_path), R.WORK).count() == 6000 - 4
        with pytest.raises(Exception, match="broken record in .*a.jsonl.gz: .*W7"):
            R.read_records(spark, str(tmp_path / "a.jsonl.gz"), R.WORK, strict=True).collect()
        assert R.read_records(spark, str(tmp_path / "a.jsonl.gz"), R.WORK).count() == 2999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
