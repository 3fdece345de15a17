import itertools
import random
from collections import Counter

from skein.llm import url_filters as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[k:]
    j = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), path[:j]


def placed(host, path):
    best = None
    for p in U.PLACES:
        if (host == p.host or host.endswith("." + p.host)) and path.startswith(p.path) and (best is None or len(p.name) > len(best.name)):
            best = p
    return best


URLS = [None, "", "no scheme", "http://A.COM", "http://a.com/", "https://www.Example.com/en/x?q=1#f", "http://example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net?es/", "a://b://c/d", "://com/", "HTTP://WWW.EXAMPLE.COM/en", "http://Éa.com/ü/?x=%20&y"]


def make(n=500):
    r = random.Random(8)
    rows = [(i, f"https://{r.choice(['spam', 'good', 'shop'])}.{r.choice(['example', 'site'])}.org/{r.choice(['casino', 'news', 'blog'])}/{r.choice(['bonus', 'tip'])}-{i}?{r.choice(['ref=1', 'id=2', ''])}") for i in range(n)]
    labels = [(i, 1, int(("spam." in u and "casino" in u and r.random() < 0.95) or r.random() < 0.03)) for i, u in rows if i % 4]
    return rows + [(n + k, u) for k, u in enumerate(URLS)] + [(None, rows[0][1]), (3, rows[3][1])], labels


def test_judgement_against_brute_force(spark):
    rows, labels = make()
    df = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toks = {r.url: r.tokens for r in U.split(df).withColumn("tokens", U.tokens()).collect()}
    bad = {i: t for i, _, t in labels}
    labelled = [(toks[u], bad[i]) for i, u in rows if i in bad]
    n, b = Counter(), Counter()
    for t, y in labelled:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(t, k):
                n[c] += 1
                b[c] += y
    strong = {c for c in n if n[c] >= U.SUPPORT and b[c] >= U.CONFIDENCE * n[c]}
    minimal = {c for c in strong if not any(set(s) < set(c) for s in strong)}
    got = U.judge(df, lab).collect()
    assert len(got) == len(rows) and minimal
    want = Counter()
    for i, u in rows:
        host, path = parts(u)
        p = placed(host, path)
        hit = any(set(c) <= set(toks[u]) for c in minimal)
        want[i, host, path, p and p.name, p.verdict if p else "block" if hit else "allow"] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert sum(r.pattern is not None for r in got) > 20


def test_without_labels_or_pages(spark):
    rows, labels = make(20)
    df, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r.pattern is None for r in U.judge(df, lab.limit(0)).collect())
    assert U.judge(df.limit(0), lab).collect() == []


def test_rules_of_the_most_frequent_of_many_tokens(spark):
    r, rows = random.Random(3), []
    for i in range(400):
        x, y = r.random() < 0.5, r.random() < 0.5
        some = [f"t{k}" for k in range(24) if r.random() < 0.1] + [f"u{k}" for k in range(24)] * (i % 10 == 0)
        rows.append((sorted(some + ["x"] * x + ["y"] * y), x and y))
    got = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert ["x", "y"] in [q["items"] for q in got]
    for q in got:
        has = [bad for t, bad in rows if set(q["items"]) <= set(t)]
        assert q.support == len(has) >= U.SUPPORT and abs(q.confidence - sum(has) / len(has)) < 1e-9 and q.confidence >= U.CONFIDENCE


def test_all_rules_of_up_to_four_tokens_of_long_urls(spark):
    r, rows = random.Random(11), []
    for i in range(300):
        t = {f"t{k:02d}" for k in range(40) if r.random() < 0.45}
        rows.append((sorted(t), {"t01", "t14", "t27", "t39"} <= t or {"t05", "t33"} <= t and r.random() < 0.9))
    got = {tuple(q["items"]): (q.support, round(q.confidence, 9)) for q in U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 12, 0.85).collect()}
    sets = [(set(t), y) for t, y in rows]
    strong = {}
    for k in range(1, 5):
        for c in itertools.combinations([f"t{j:02d}" for j in range(40)], k):
            if any(set(x) < set(c) for x in strong):
                continue
            has = [y for t, y in sets if t.issuperset(c)]
            if len(has) >= 12 and sum(has) >= 0.85 * len(has):
                strong[c] = (len(has), round(sum(has) / len(has), 9))
    assert {c: v for c, v in got.items() if len(c) <= 4} == strong and len(strong) > 1


def test_support_grows_with_the_labelled_urls(spark):
    rows = [(["a"], True)] * 6 + [(["b"], True)] * 40 + [(["c"], False)] * 54
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    assert {tuple(r["items"]) for r in U.mine(df).collect()} == {("a",), ("b",)} and {tuple(r["items"]) for r in U.mine(df, share=0.1).collect()} == {("b",)}


def test_a_rule_of_five_tokens_that_only_long_urls_carry(spark):
    r, rows = random.Random(5), []
    noise = [f"n{k:03d}" for k in range(200)]
    bag = lambda times: sum((r.sample(noise, len(noise)) for _ in range(times)), [])
    for bad, n in ((True, 50), (False, 100)):
        some = bag(n * 20 // len(noise))
        for i in range(n):
            part = list("abcde")
            if not bad:
                part.remove("abcde"[i % 5])
            rows.append((sorted({*part, *some[i * 20 : i * 20 + 20]}), bad))
    assert min(len(t) for t, _ in rows) > 20
    got = {tuple(q["items"]): (q.support, q.confidence) for q in U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support=8).collect()}
    assert got[tuple("abcde")] == (50, 1.0)
    for items, (support, confidence) in got.items():
        has = [bad for t, bad in rows if set(items) <= set(t)]
        assert support == len(has) >= 8 and abs(confidence - sum(has) / len(has)) < 1e-9 and not any(set(x) < set(items) for x in got)
