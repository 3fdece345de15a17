import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import fill_middle as M
from skein.llm import rope as R
from skein.llm.queries import op13_fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = UNIT.findall(text)
    low, high = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if d % 100 < spm:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n, seed=3):
    r = random.Random(seed)
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", "é", "日本", "😀", "\x0b", " ", "<", ">", "P>", "<S"]
    return ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 30, 400]))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [4, 7, 64, 2048])
def test_splits_and_counts(monkeypatch, leaf):
    monkeypatch.setattr(R, "LEAF", leaf)
    for t in [*texts(80), " " * 50, "x" * 50, "日" * 50 + " " + "é" * 50]:
        rope, u = R.build(t.encode()), UNIT.findall(t)
        assert (rope.units, rope.chars, R.text_of(rope).decode()) == (len(u), len(t), t)
        for k in sorted({0, 1, len(u) // 2, len(u)}):
            a, b = R.split_units(rope, k)
            assert (R.text_of(a).decode(), R.text_of(b).decode()) == ("".join(u[:k]), "".join(u[k:]))
            assert (a.units, b.units, a.chars + b.chars) == (min(k, len(u)), max(len(u) - k, 0), len(t))
            back = R.join(a, b)
            c, d = R.split_units(back, len(u) // 3)
            assert R.text_of(c).decode() == "".join(u[: len(u) // 3]) and c.units + d.units == len(u)
        for k in (0, 1, len(t) // 2, len(t)):
            a, b = R.split_chars(rope, k)
            assert (R.text_of(a).decode(), R.text_of(b).decode()) == (t[:k], t[k:])
        for what in ("<P>", "P>", "a<"):
            assert R.find(rope, what.encode()) == t.find(what)


def test_against_plain_statement(spark):
    rows = [(k * 7919 - 40_000, t) for k, t in enumerate(texts(300))]
    rows += [(1, None), (2, ""), (None, "no id here"), (3, "has <P> inside"), (4, " \n\t "), (5, "word " * 60_000), (6, "é" * 70_000), (7, "same"), (7, "same"), (7, "other text of seven"), ((1 << 62) + 1, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "one", "restored")})
    for opts in ({}, {"rate": 100, "spm": 0}, {"rate": 100, "spm": 100}):
        out = M.restore(M.transform(df, rate=opts.get("rate", 50), spm_rate=opts.get("spm", 80)))
        got = out.collect()
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted((plain(*x, **opts) for x in rows), key=str)
        assert sorted(((r.doc_id, r.restored) for r in got), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    forms = {r.form for r in M.transform(df).collect()}
    assert forms == {"plain", "spm", "psm"}
    assert M.restore(M.transform(df.limit(0))).collect() == []


def test_restore_of_what_is_no_output(spark):
    rows = [("spm", "no sentinels"), ("psm", "x<P>a<S>b<M>c"), ("psm", None), (None, "text"), ("plain", "<P>"), ("psm", "<P>a<S>b<M>c")]
    got = M.restore(spark.createDataFrame(rows, "form string, output string")).collect()
    assert [r.restored for r in got] == [None, None, None, None, "<P>", "acb"]


def test_query(spark, tmp_path):
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts(50))], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_fill_middle(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts(50)):
        want = plain(k, t)
        assert got[k].output_sha256 == hashlib.sha256(want[5].encode()).hexdigest() and got[k].restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
