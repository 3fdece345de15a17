import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import line_dedup as L
from skein.llm import store
from skein.llm.queries import op12_line_dedup

WHITE = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    low = -(1 << 63)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(low if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        lost = [len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != (low if d is None else d) if key(x) in holders else False for x in lines]
        out.append((d, len(lines), sum(lost), "\n".join(x for x, y in zip(lines, lost, strict=True) if not y)))
    return out


def make(seed=5):
    r = random.Random(seed)
    lines = [f"  Shared Line number {k} of all documents\t" for k in range(12)] + ["This Line is HELD by many É", "this line is held by many É", "this line is held by many é", "ÀÉÎ ÄÖÜ ß ascii TAIL of it", "\x0bsmall", "", "  ", "only\x85inner\xa0white space here "]
    lines += [f"rare line {k} that hardly any other has" for k in range(150)]
    rows = [(r.randrange(-50, 400), "\n".join(r.choice(lines) for _ in range(r.choice([1, 2, 8, 40])))) for _ in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, lines[0]), (None, lines[0] + "\nx"), (1003, rows[0][1]), (1003, rows[0][1]), (1003, lines[3] + "\n" + lines[4]), (1004, "\n".join(lines[k % 12] for k in range(20_000))), ((1 << 62) + 5, lines[1] + "\n" + lines[1])]
    return rows


def found(df, **opts):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in L.drop_lines(df, **opts).collect()), key=str)


@pytest.mark.parametrize("broadcast_rows", [500_000, 20, 1])
def test_against_plain_statement(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(store, "BROADCAST_ROWS", broadcast_rows)
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("d", "th", "pos", "h1", "key", "lines", "drop", "n")})
    assert found(df) == sorted(plain(rows), key=str)
    assert found(df, least_chars=1, least_docs=2) == sorted(plain(rows, 1, 2), key=str)
    assert any(n and not kept for _, _, n, kept in plain(rows))


def test_nothing_and_nothing_shared(spark):
    df = spark.createDataFrame(make(), "doc_id long, text string")
    assert found(df.limit(0)) == []
    assert found(df.limit(2)) == sorted(plain([tuple(r) for r in df.limit(2).collect()]), key=str)


def test_one_line_in_every_document(spark):
    hot = "every document of the table holds this line"
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(hot + "\n"), F.col("id").cast("string")).alias("text"))
    got = L.drop_lines(df).agg(F.sum("n_dropped").alias("n"), F.count_if(F.contains("kept", F.lit(hot))).alias("k"), F.max(F.when(F.col("n_dropped") == 0, F.col("doc_id"))).alias("last")).first()
    assert (got.n, got.k, got.last) == (29_999, 1, 29_999)


def test_query(spark, tmp_path):
    rows = [(k, t) for k, (_, t) in enumerate(make())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_line_dedup(spark, str(tmp_path)).collect()}
    for d, n, k, kept in plain(rows):
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == (n, k, hashlib.sha256(kept.encode()).hexdigest())
