import glob
import os
import random
import uuid
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from skein.llm import token_coder as C
from skein.llm import token_files as T

TOKENIZER = next(iter(glob.glob("/opt/tokenizers/byte_bpe_50k.json")), None)


def sequences():
    r = np.random.default_rng(1)
    yield np.zeros(0, np.int64)
    yield np.array([65535])
    yield np.zeros(5000, np.int64)
    yield r.integers(0, 65536, 3000)
    yield r.integers(0, C.LIMIT, 3000)
    yield np.minimum(r.zipf(1.3, 9001), 65535)
    yield np.minimum(r.zipf(1.3, 2 * C.BLOCK + 5), 65535)
    words = [r.integers(0, 50257, 3) for _ in range(40)]
    yield np.concatenate([words[i] for i in r.integers(0, 40, 3000)])


def test_both_coders_write_the_same_and_read_it_back(spark):
    every = [(k, bytearray(x.astype("<u4").tobytes()), C.nibbles_of(x), len(x)) for k, x in enumerate(sequences())]
    df = spark.createDataFrame(every, "k int, ids binary, nibbles int, n long").withColumn("body", C.encoded(spark, F.col("ids"), F.col("nibbles")))
    rows = df.withColumn("back", C.decoded(spark, F.col("n"), F.col("body"), F.col("nibbles"))).orderBy("k").collect()
    for r, ids in zip(rows, sequences(), strict=True):
        assert r.back == r.ids and (C.decode_body(bytes(r.body), len(ids), r.nibbles) == ids).all()
        if len(ids) < 10_000:
            assert bytes(r.body) == C.encode_body(ids, r.nibbles)
    with pytest.raises(ValueError):
        C.nibbles_of(np.array([C.LIMIT]))
    other = spark.newSession()
    assert other.range(1).select(C.encoded(other, F.lit(bytearray([1, 0, 0, 0])), F.lit(4)).alias("b")).first().b == C.encode_body(np.array([1]), 4)


@pytest.mark.skipif(TOKENIZER is None or not os.path.isdir("/root/testdata/sf0.001"), reason="no tokenizer file or tables")
def test_fewer_bits_than_zlib_and_than_single_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1)
    f = T.frames(docs, TOKENIZER).withColumn("body", C.encoded(spark, F.col("ids"), F.col("nibbles"))).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in f])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * sum(len(r.body) for r in f) / len(ids)
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) and bits < -(share * np.log2(share)).sum()


def test_damage_is_noticed_and_blocks_are_independent(spark):
    ids = np.arange(2 * C.BLOCK + 9) % 50_000
    body = bytes(spark.createDataFrame([(bytearray(ids.astype("<u4").tobytes()),)], "ids binary").select(C.encoded(spark, F.col("ids"), F.lit(4)).alias("b")).first().b)
    assert (C.decode_body(body, len(ids), 4, block=1) == ids[C.BLOCK : 2 * C.BLOCK]).all()
    small = C.encode_body(ids[:400], 4)
    r = random.Random(2)
    for _ in range(25):
        bad = bytearray(small)
        bad[r.randrange(len(bad) - 4)] ^= 1 << r.randrange(8)
        with pytest.raises(ValueError):
            C.decode_body(bytes(bad), 400, 4)
        with pytest.raises(Exception, match="damaged|cut short"):
            spark.createDataFrame([(bad,)], "b binary").select(C.decoded(spark, F.lit(400), F.col("b"), F.lit(4))).collect()
    with pytest.raises(ValueError):
        C.decode_body(small[:40], 400, 4)


@pytest.mark.skipif(TOKENIZER is None, reason="no tokenizer file")
def test_documents(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    r = random.Random(4)
    rows = [(r.randrange(-5000, 5000) * 2, " ".join(r.choice(["the", "çon", "<|endoftext|>", "12", "\n", "中"]) for _ in range(r.randrange(0, 90)))) for _ in range(300)]
    rows += [(9001, None), (9003, ""), (9005, "word " * 30_000), (None, "null id"), (None, None), (77, "same"), (77, "same"), (77, "Same"), (77, "same, and more"), (77, None), (77, "中"), (77, "z" * 40 + "b"), (77, "z" * 40 + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit(2))
    to = f"file://{tmp_path}/{uuid.uuid4().hex}"
    T.write_tokens(df.repartition(5), TOKENIZER, to)
    got = sorted((tuple(x) for x in T.read_tokens(spark, to).collect()), key=lambda x: x[1])
    at, want = 0, []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert [(d, s, n, zlib.crc32(b)) for d, s, n, b in got] == want
    none = f"file://{tmp_path}/none"
    T.write_tokens(df.limit(0), TOKENIZER, none)
    assert T.read_tokens(spark, none).collect() == []
    bad = spark.read.parquet(to).withColumn("n_ids", F.col("n_ids") + 1)
    bad.write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="damaged|cut short"):
        T.read_tokens(spark, f"file://{tmp_path}/bad").collect()
