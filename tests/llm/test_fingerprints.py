import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from skein.llm import fingerprints as P


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        out.append((d, t, e, nxt))
    return out


def weighted_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def make(n=400, seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéfg") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    rows = [(r.randrange(-900, 2000) * 3 + k % 3, " ".join(r.choice(vocab[: r.choice([20, 400])]) for _ in range(r.choice([1, 5, 60, 300])))) for k in range(n)]
    return list({d: (d, t) for d, t in rows}.values()) + [(9001, None), (9002, ""), (9002, ""), (None, "null id"), (9003, rows[0][1]), (9004, rows[0][1]), (9005, "z " * 40_000)]


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 50)
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.fingerprints(df, 32).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want), key=str)
    text = {d: (t, e, x) for d, t, e, x in want if d != 9002}
    by_text = {}
    off = []
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in text:
            t, e, x = text[r.doc_id]
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
            assert by_text.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
            off += [r.near_edited - weighted_jaccard(t, e) if t.split() else 0, r.near_next - weighted_jaccard(t, x) if t.split() and x.split() else 0]
    assert abs(sum(off) / len(off)) < 0.01 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.09
    assert P.fingerprints(df.limit(0)).collect() == []
    one = P.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = {"x": 5, "y": 1, "z": 2}, {"x": 2, "y": 3, "q": 2}
    rows = [(s, w, float(n)) for s, t in enumerate((a, b)) for w, n in t.items()]
    df = spark.createDataFrame(rows, "side int, w string, n double").select("side", F.xxhash64("w").alias("w"), F.log("n").alias("n"))
    cols = [F.min(P.sample(F.col("w"), F.col("n"), i)).alias(f"m{i}") for i in range(1500)]
    same = 0
    for k in range(0, 1500, 100):
        p, q = df.groupBy("side").agg(*cols[k : k + 100]).orderBy("side").collect()
        same += sum((p[i] ^ q[i]) & ((1 << 26) - 1) == 0 for i in range(1, 101))
    assert abs(same / 1500 - (2 + 1) / (5 + 3 + 2 + 2)) < 0.04
