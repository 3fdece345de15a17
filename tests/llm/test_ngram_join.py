import random
import re
import string

from skein.llm import ngram_join as J
from skein.operators.communities import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, width):
    w = WORD.findall((text or "").translate(A_Z))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, width=3, percent=90):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def make(seed, n=260):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows, k = [], 0
    while len(rows) < n:
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 8, 12, 13, 20, 40, 100, 300]))]
        for _ in range(r.choice([1, 1, 2, 9, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                at = r.randrange(len(w))
                how = r.random()
                if how < 0.5:
                    w[at] = r.choice(vocab)
                elif how < 0.75 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, r.choice(vocab))
            rows.append((k, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
            k += 1
    r.shuffle(rows)
    return rows + [(k, None), (k + 1, None), (k + 2, ""), (k + 3, " \n"), (rows[0][0], rows[0][1]), (None, rows[1][1]), (rows[5][0], rows[9][1]), (rows[6][0], "one more text under a known id"), (None, "only here"), (None, "only here too then")]


def test_against_brute_force(spark):
    for seed, width, percent in ((1, 3, 90), (2, 3, 90), (3, 5, 80)):
        rows = make(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(map(tuple, J.near_duplicates(df, width, percent).collect()), key=str)
        assert got == brute(rows, width, percent)


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(200):
        w = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            w[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(df).collect()), key=str) == brute(rows)


def test_one_of_each_and_empty(spark):
    rows = make(4, 120)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, source string, n long")
    kept = J.one_of_each(df, 3, 90)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert kept.columns == df.columns and sorted(ids) == sorted({d for d, _, c in brute(rows) if d == c and d is not None})
    assert J.near_duplicates(df.limit(0)).collect() == [] and J.one_of_each(df.limit(0)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 400)] + [(5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(300, 400)} == {7} and 5 not in got
