import random
import re
from collections import defaultdict

from skein.llm import mixing as M


def fill(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / (sum(w[s] for s in rest) or 1)
        over = [s for s in rest if w[s] * share > cap * sizes[s]]
        if not over:
            return fixed | {s: w[s] * share for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def make(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(r.expovariate(1 / 60)) + (["z\t\nq"] if i % 3 == 0 else [])), r.choice(["a"] * 6 + ["b", "é", None, "tiny"]) if i % 97 else "tiny") for i in range(n)]
    rows += [(n, None, "a"), (n, None, "a"), (n + 1, "", None), (n + 2, "x y", "only")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_nearness(spark):
    for n in (0, 3, 40, 3000):
        rows, df = make(spark, n)
        out = M.copies(df).collect()
        assert len(out) == len(rows)
        size, per, taken, want = {}, defaultdict(int), defaultdict(int), {}
        src = {i: s for i, _, s in rows}
        for _, t, s in rows:
            per[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want = fill(per)
        for r in out:
            s = src[r.doc_id]
            size.setdefault(s, []).append(r.size)
            assert r.source_size == per[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.copies <= 3
            taken[s] += r.copies * r.size
        for s in per:
            assert abs(taken[s] - want[s]) <= max(size[s]), (n, s, taken[s], want[s])
            if n == 3000:
                assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5


def test_reruns_agree_whatever_the_partitions(spark):
    _, df = make(spark, 900)
    key = lambda d: sorted((r.doc_id, r.h, r.copies) for r in M.copies(d).collect())
    assert key(df.repartition(1)) == key(df.repartition(7, "text"))


def test_expectation(spark):
    """Over many seeds every document is taken as often as its rate says, in a source of one document, of few of skewed sizes, and of many."""
    r = random.Random(5)
    rows = [(i, "w " * r.choice([3, 5, 9, 40, 300]), "ab"[i % 25 == 0]) for i in range(300)] + [(900, "w " * 11, "one")] + [(901, "w " * 7, "c")] * 5
    many = spark.createDataFrame([(i + 10_000 * k, t, f"{k:03d}{s}") for k in range(120) for i, t, s in rows[::3] + rows[-6:]], "doc_id long, text string, source string")
    want, got, times = {}, defaultdict(float), 120
    for x in M.copies(many, weights=(1,), reserve=40, fan=8).collect():
        d = x.doc_id % 10_000
        got[d] += x.copies / times
        want[d] = want.get(d, 0) + x.target / x.source_size / times
        assert 0 <= x.copies <= 3
    for d in want:
        f = want[d] % 1
        assert abs(got[d] - want[d]) <= 4.5 * (max(f * (1 - f), 0.01) * (5 if d == 901 else 1) / times) ** 0.5 + 0.01, (d, got[d], want[d])


def test_rates_of_seeds_in_a_small_source(spark):
    sizes = [1000, 400, 100, 50, 50, 20, 20, 10, 5, 3] * 2
    rows = [(i, "w " * n, f"s{k:03d}") for k in range(200) for i, n in enumerate(sizes)] + [(99, "w " * 40_000, "zz")]
    out = [x for x in M.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).collect() if x.doc_id != 99]
    rate, taken, per = {}, defaultdict(list), defaultdict(int)
    for x in out:
        rate[x.target / x.source_size] = 1
        taken[round(x.target / x.source_size, 9), x.doc_id].append(x.copies)
    for (f, d), c in taken.items():
        p = f % 1
        assert abs(sum(c) / len(c) - f) <= 4.5 * (p * (1 - p) / len(c)) ** 0.5 + 1e-6, (f, d)


def test_repeated_rows_share_their_copies(spark):
    df = spark.createDataFrame([(1, "a b c", "x")] * 500 + [(2, "a b c d", "x")] * 3 + [(i, "q " * 20, "y") for i in range(3, 60)], "doc_id long, text string, source string")
    out = M.copies(df, weights=(1, 5)).collect()
    mine = [r.copies for r in out if r.doc_id == 1]
    assert len(out) == df.count() and len(mine) == 500 and max(mine) - min(mine) <= 1
    assert M.mix_documents(df, weights=(1, 5)).count() == sum(r.copies for r in out)


def test_rows_come_as_often_as_counted(spark):
    rows, df = make(spark, 500)
    want = defaultdict(int)
    for r in M.copies(df).collect():
        want[r.doc_id] += r.copies
    got = defaultdict(int)
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)
