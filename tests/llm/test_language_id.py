import numpy as np
import pandas as pd
import pyarrow as pa

from skein.llm import language_id as L
from skein.llm.textkit import Words

SENTENCES = {
    "en": "the cat sat on the mat and looked at the other animals that were there with them in the house",
    "fr": "le chat est assis sur le tapis et regarde les autres animaux qui étaient là avec eux dans la maison",
    "de": "die katze saß auf der matte und schaute die anderen tiere an die dort mit ihnen im haus waren",
}


def corpus(spark):
    rows = []
    for k, (lang, s) in enumerate(SENTENCES.items()):
        w = s.split()
        rows += [(1000 * k + i, " ".join(w[(i * 5 + j * 3) % len(w)] for j in range(4 + i % 20)), lang) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_edges(spark):
    docs = corpus(spark)
    train, test = docs.filter(~L.held_out(docs.doc_id)), docs.filter(L.held_out(docs.doc_id))
    model = L.fit(train)
    got = L.predict(test, model).collect()
    assert len(got) == test.count() and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got) + 1
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 34 !?", "fr"), (3, "12 34 !?", "fr"), (4, "中文字符", "en"), (5, "THE CAT AND THE MAT", None), (6, "the cat " * 200_000, "de"), (None, "le chat et les animaux", "de"), (7, "zq xj kv wq zx jq vk qz xq " * 20, "en")], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in L.predict(odd, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0 and by[1].rejected
    assert by[4].lang_pred in SENTENCES and by[5].lang_pred == "en" and by[6].lang_pred == "en" and by[None].lang_pred == "fr"
    assert by[7].rejected and not by[6].rejected
    assert L.predict(odd.limit(0), model).collect() == []
    assert {r.lang_pred for r in L.predict(odd, L.fit(docs.limit(0))).collect()} == {"und"}


def test_label_source_and_id_are_no_inputs(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    a = L.predict(docs, model).select("text", "lang_pred", "score").distinct().count()
    b = L.predict(docs.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang"), model).select("text", "lang_pred", "score").union(L.predict(docs, model).select("text", "lang_pred", "score")).distinct().count()
    assert a == b == docs.select("text").distinct().count()


def test_words_against_split():
    texts = [None, "", "  a\tbb\x0bccc\r\nd ", "é È É", "one", " ", "x" * 5000 + " y", "a b c d"]
    w = Words(pa.array(texts), lower=True)
    want = [(t or "").encode().lower().split() for t in texts]
    assert list(w.counts()) == list(map(len, want))
    flat = [x for t in want for x in t]
    got = [bytes(w.raw[s : s + n]) for s, n in zip(w.start, w.length, strict=True)]
    assert got == flat
    assert len({(a, b) for a, b in zip(flat, w.hash.tolist(), strict=True)}) == len(set(flat)) == len(set(w.hash.tolist()))
    sh, first = w.shingles(3)
    assert list(pd.Series(first).diff().dropna().astype(int)) == [max(len(t) - 2, 1 if t else 0) for t in want]


def plain_bins(text):
    """n-grams of one to three bytes as numbers, with a blank on both sides, hashed to bins; one by one."""
    letters = []
    for b in text.lower().encode():
        s = b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0
        if s or (letters and letters[-1]):
            letters.append(s)
    padded = [0, *letters, 0]
    values = list(letters)
    values += [155 * a + b + 1000 for a, b in zip(padded, padded[1:])]
    values += [(155 * a + b) * 155 + c + 100_000 for a, b, c in zip(padded, padded[1:], padded[2:])]
    out = {}
    for h in values:
        h &= 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        h = (((h ^ (h >> 12)) * 0x297A2D39) & 0xFFFFFFFF) >> 19
        out[h] = out.get(h, 0) + 1
    return out


def test_nearest_centroid_against_a_plain_statement(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    extra = [(9000, "Ça va?  ÉTÉ à la maison -- 12 chats", "x"), (9001, "der Bär saß", "x"), (9002, "a", "x"), (9003, "the cat\n\n\nsat " * 5000, "x"), (9004, "中文 字符 and the mat", "x"), (9004, "  le chat  ", "x")]
    rows = docs.filter("doc_id % 7 = 0").union(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "lang AS lang_pred", "doc_id AS score")
    checked = 0
    for r in L.predict(rows, model, ["doc_id", "text"]).collect():
        v = {b: np.log1p(n) * float(model.idf[b]) for b, n in plain_bins(r.text).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(float(c[b]) * x for b, x in v.items()) / norm for c in model.centroids]
        best = max(cos)
        assert abs(r.score - min(max(best, 0), 1)) < 1e-8
        assert r.lang_pred in {model.languages[model.owner[i]] for i, x in enumerate(cos) if x > best - 1e-9}
        checked += 1
    assert checked > 50
