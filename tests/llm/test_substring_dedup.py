import random

import numpy as np

from skein.llm import substring_dedup as D


def test_windows_are_the_tree_nodes_of_some_size():
    r = random.Random(2)
    for least in (1, 2, 3, 7):
        for _ in range(60):
            texts = [[r.randrange(1, 12) << 40 for _ in range(r.randrange(0, 30))] for _ in range(4)]
            h = np.array([0] + [x for t in texts for x in [*t, 0]], np.uint64)
            got = set(zip(*map(list, D.cartesian_windows(h, least)), strict=True))
            want = set()
            for c in range(len(h)):
                if h[c] == 0:
                    continue
                left = c
                while h[left - 1] > h[c]:
                    left -= 1
                right = c
                while h[right + 1] >= h[c]:
                    right += 1
                if right - left + 1 >= least:
                    want.add((left, c, right))
            assert got == want


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def corpus(seed=1):
    """Texts by id; planted (passage, ids that have it)."""
    r = random.Random(seed)
    texts, planted = {}, []
    line = words(r, 9)
    for i in range(150):
        texts[i] = words(r, r.choice([5, 40, 80, 200, 500]))
        if i % 3 == 0:
            texts[i] += line
    for k in range(40):
        passage = words(r, r.choice([51, 52, 60, 90, 200]))
        if k % 4 == 0:
            passage[20:29] = line
        ids = r.sample(range(150, 400), r.choice([2, 2, 3, 8]))
        for i in ids:
            texts.setdefault(i, words(r, r.choice([0, 30, 120])))
            at = r.randrange(len(texts[i]) + 1)
            texts[i][at:at] = [*passage, *words(r, 3)]
        planted.append((passage, ids))
    return texts, planted


def frame(spark, texts):
    sep = [" ", "\n", "  "]
    return spark.createDataFrame([(i, "".join(w + sep[k % 7 % 3] for k, w in enumerate(t)), "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    texts, planted = corpus()
    got = D.report(frame(spark, texts)).collect()
    touched = {i for _, ids in planted for i in ids}
    assert {r.doc_id for r in got} | {r.first_doc_id for r in got} <= touched
    spans = {}
    for r in got:
        a, b = texts[r.first_doc_id][r.first_begin : r.first_end], texts[r.doc_id][r.begin : r.end]
        ga, gb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        assert len(ga & gb) / len(ga | gb) >= 0.8 and min(len(a), len(b)) >= 50
        spans.setdefault(r.doc_id, set()).update(range(r.begin, r.end))
    for passage, ids in planted:
        left = []
        for i in ids:
            at = [k for k in range(len(texts[i])) if texts[i][k : k + 12] == passage[:12]]
            if not at or texts[i][at[0] : at[0] + len(passage)] != passage:
                continue  # a later passage went into it
            whole = set(range(at[0], at[0] + len(passage)))
            if len(whole - spans.get(i, set())) >= 5:  # the first text may hold a few words less
                left.append(i)
        assert len(left) <= 1, (ids, left)


def test_changed_passages(spark):
    r, hits = random.Random(6), 0
    texts = {}
    for k in range(60):
        passage = words(r, 120)
        other = list(passage)
        other[40] = "changedword"
        del other[80]
        texts[2 * k], texts[2 * k + 1] = words(r, 100) + passage, other + words(r, 70)
    got = D.report(frame(spark, texts)).collect()
    pairs = {tuple(sorted((x.doc_id, x.first_doc_id))) for x in got if x.similarity < 1}
    hits = sum((2 * k, 2 * k + 1) in pairs for k in range(60))
    assert hits >= 58 and all(a // 2 == b // 2 for a, b in pairs)


def test_removal_and_edges(spark):
    texts, planted = corpus(3)
    rows = frame(spark, texts)
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "short text", None, None, None), (903, "short text", "en", "s", 0), (None, "a b", "en", "s", 0), (904, " ".join(texts[160] if 160 in texts else texts[3]), "en", "s", 0), (905, " ".join(texts[160] if 160 in texts else texts[3]), "en", "s", 0)], rows.schema)
    df = rows.union(extra)
    out = D.remove_passages(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert {900, 901, 902, 903, None} <= set(got) and got[900] is None and len({904, 905} & set(got)) <= 1
    clean = [i for i in texts if not any(i in ids for _, ids in planted)]
    before = {r.doc_id: r.text for r in df.collect()}
    assert all(got[i] == before[i] for i in clean if i not in (3, 160))
    for passage, ids in planted:
        left = [i for i in [*ids, 904, 905] if " ".join(passage) in " ".join((got.get(i) or "").split())]
        assert len(left) <= 1
    assert D.report(df.limit(0)).collect() == [] and D.remove_passages(df.limit(0)).collect() == []


def test_hot_keys_in_parts(spark, monkeypatch):
    texts, _ = corpus(5)
    r = random.Random(1)
    passage = words(r, 60)
    for i in range(500, 700):
        texts[i] = words(r, 20) + passage
    df = frame(spark, texts)
    plain = {(x.doc_id, x.begin, x.end) for x in D.report(df).collect()}
    monkeypatch.setattr(D, "HOT_SAMPLE", 1)
    monkeypatch.setattr(D, "HOT_SEEN", 2)
    parted = D.report(df).collect()
    assert {(x.doc_id, x.begin, x.end) for x in parted} == plain
    kept = [r.text for r in D.remove_passages(df).collect() if " ".join(passage) in " ".join((r.text or "").split())]
    assert len(kept) == 1


def test_two_passages_on_one_diagonal(spark):
    r = random.Random(9)
    texts, want = {}, set()
    for k in range(30):
        p1, p2 = words(r, 55), words(r, 55)
        for i in (2 * k, 2 * k + 1):
            texts[i] = p1 + words(r, 30) + p2
        want |= {(k, 0), (k, 85)}
    got = {(x.doc_id // 2, x.begin) for x in D.report(frame(spark, texts)).collect()}
    assert got == want


def test_passage_beside_the_stretches_of_an_alignment_that_fails():
    r = np.random.default_rng(4)
    a, b = (r.integers(1, 1 << 31, 200).astype(np.uint32) for _ in range(2))
    some = np.arange(200) % 16 < 5
    again = np.arange(200)[some & (np.arange(200) >= 100) & (np.arange(200) < 155)]
    a[again] = a[again - 80]
    b[some] = a[some]
    b[100:155] = a[20:75]
    got = D.passages(a, b, [(0, 0), (40, 120)])
    assert [x[:4] for x in got] == [(20, 75, 100, 155)]


def test_passage_of_parts_that_earlier_texts_hold_apart(spark):
    r, texts, late = random.Random(12), {}, []
    for k in range(6):
        passage = words(r, 52)
        for n in range(40):
            texts[1000 * k + n] = words(r, 60) + (passage[:44] if n % 2 else passage[8:]) + words(r, 60)
        for n in (100, 101):
            texts[1000 * k + n] = words(r, 60) + passage + words(r, 60)
        late.append((1000 * k + 100, 1000 * k + 101))
    got = D.report(frame(spark, texts)).collect()
    assert sorted(tuple(sorted((x.doc_id, x.first_doc_id))) for x in got) == late


def test_third_texts_that_hold_most_of_a_passage(spark):
    """Each pair shares 55 words; five other texts hold 45 of them, too few for a passage of their own."""
    r, texts, want = random.Random(31), {}, set()
    for k in range(100):
        passage = words(r, 55)
        for n in range(5):
            at = r.randrange(11)
            texts[100 * k + n] = words(r, 70) + passage[at : at + 45] + words(r, 70)
        for n in (50, 51):
            texts[100 * k + n] = words(r, 70) + passage + words(r, 70)
        want.add((100 * k + 50, 100 * k + 51))
    got = {tuple(sorted((x.doc_id, x.first_doc_id))) for x in D.report(frame(spark, texts)).collect()}
    assert got == want
