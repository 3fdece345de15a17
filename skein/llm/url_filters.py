"""URL filtering by association rules.

A URL is a set of tokens: scheme, host labels, words of the path, query keys; digits read as `#`. FP-growth mines the
token combinations of bad labelled URLs, and those of very long ones grow level by level; each is then counted over all labelled URLs, and it blocks if it is seen often enough, if
enough of the URLs that have it are bad, and if no part of it blocks already. Rules are matched through an inverted index on each
rule's rarest token. Lists of allowed and blocked places come first.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.store import broadcast_if_small, cut

#: A rule's least number of URLs, at least and as a share of the labelled ones, and the share of bad ones among them.
SUPPORT, SUPPORT_SHARE, CONFIDENCE = 5, 1e-5, 0.8
#: Usable tokens of a URL that FP-growth is given whole. What longer URLs have is grown level by level, as a set of n tokens has 2 ** n parts.
WHOLE = 16


@dataclass(frozen=True)
class Place:
    """A host with its subdomains, from a path on; verdict: allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


PLACES = (Place("allow", "com", "/"), Place("block", "example.com", "/en/"), Place("allow", "www.example.com", "/en/"), Place("block", "net", "/es/"), Place("block", "net", "/fr/"))


def split(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (from there up to `?`, `#` or the end); both empty without `://` or url."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", lower).withColumn("path", path)


def place(host: Column, path: Column, places: tuple[Place, ...] = PLACES) -> Column:
    """The longest of the places (a list in the code, some hundreds at most) that a URL lies in: (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for p in sorted(places, key=lambda p: (len(p.name), p.name)):
        inside = ((host == p.host) | host.endswith("." + p.host)) & path.startswith(p.path)
        found = F.when(inside, F.struct(F.lit(p.name).alias("rule"), F.lit(p.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL that `split` has taken apart, sorted; null url: none."""
    number = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    typed = lambda kind, arr: F.transform(F.array_remove(arr, ""), lambda x: F.concat(F.lit(kind), x))
    lower = F.lower(F.coalesce(F.col(url), F.lit("")))
    query = F.split(F.regexp_extract(lower, r"\?([^#]*)", 1), "&")
    return F.array_sort(F.array_distinct(F.concat(
        typed("s:", F.array(F.regexp_extract(lower, "^([a-z]+)://", 1))), typed("h:", F.split(number(F.col("host")), r"\.")),
        typed("p:", F.split(number(F.lower(F.col("path"))), "[/._-]+")), typed("q:", F.transform(query, lambda x: number(F.substring_index(x, "=", 1)))))))


def _grown(alive: DataFrame, long: DataFrame, size: int) -> DataFrame:
    """items: combinations of a size that a long URL (items, sorted) may have and whose parts may all be alive: of two tokens the pairs of each URL, of more those that two living ones with all but their last token in common give."""
    if size == 2:
        pair = F.explode(F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.array(x, y)))))
        return long.select(pair.alias("items")).distinct()
    ends = alive.select(F.slice("items", 1, size - 2).alias("head"), F.element_at("items", -1).alias("end"))
    return ends.join(ends.select("head", F.col("end").alias("other")), "head").filter("end < other").select(F.concat("head", F.array("end", "other")).alias("items"))


def mine(labelled: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, share: float = SUPPORT_SHARE) -> DataFrame:
    """labelled: tokens, bad (boolean). Rules: items (array), key (the rarest item), confidence, support.

    FP-growth mines the bad URLs of up to WHOLE usable tokens; what occurs in a longer one is grown token by token from combinations that are frequent and do not block. So all rules are found, however long they or their
    URLs are, and the numbers are those of all labelled URLs. Tokens that exactly the same labelled URLs
    have are mined as one, and a rule of it is given for each of them. No labelled URL, or none that is bad: no rule. The result is materialised.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = cut(labelled.select("tokens", "bad").filter(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id()), "url-labelled")
    support = max(support, math.ceil(share * rows.count()))
    # A combination that blocks is as frequent among the bad ones as it has to be in all, and so is each token of it.
    least = math.ceil(confidence * support)
    each = rows.select("id", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1))).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2"))
    tokens_ = cut(seen.filter(F.col("b") >= least).withColumn("one", F.min("token").over(Window.partitionBy("n", "b", "s1", "s2"))), "url-tokens")
    strong = (F.col("n") >= support) & (F.col("b") / F.col("n") >= confidence)
    counts = tokens_.filter("token = one").select(F.array("token").alias("items"), "n", "b")
    rules = counts.filter(strong)
    alive = cut(counts.filter(~strong), "url-alive")
    weak = broadcast_if_small(cut(alive.select(F.col("items")[0].alias("token")), "url-weak"))
    bags = cut(each.filter("bad").join(weak, "token").groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("items")).select("items"), "url-bags")
    short, long = bags.filter(F.size("items") <= WHOLE), bags.filter(F.size("items") > WHOLE)
    total, grows, longest = short.count(), bool(long.limit(1).count()), 1
    if total >= least:
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(short).freqItemsets
        found = cut(found.select(F.array_sort("items").alias("items")).filter(F.size("items") > 1), "url-combinations")
        longest = found.agg(F.max(F.size("items"))).first()[0] or 1
    if grows or longest > 1:
        rarity = broadcast_if_small(cut(tokens_.select("token", F.col("n").alias("rarity")), "url-rarity"))
        size = 1
        while grows or size < longest:
            size += 1
            # A combination is tried if none of its parts blocks and all are frequent. One that as many URLs have as a part of it is left: the two are the same URLs.
            some = [found.filter(F.size("items") == size).select("items")] if size <= longest else []
            some += [_grown(alive, long, size)] if grows else []
            parts = functools.reduce(DataFrame.union, some).distinct().select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
            tried = parts.join(broadcast_if_small(alive.select(F.col("items").alias("part"), F.col("n").alias("of"))), "part").groupBy("items").agg(F.count("*").alias("known"), F.min("of").alias("of")).filter(F.col("known") == size)
            keyed = cut(tried.select("items", "of", F.explode("items").alias("token")).join(rarity, "token").groupBy("items", "of").agg(F.min(F.struct("rarity", "token"))["token"].alias("token")), "url-tried")
            if not keyed.limit(1).count():
                break
            had = rows.select("tokens", "bad", F.explode("tokens").alias("token")).join(broadcast_if_small(keyed), "token").filter(F.size(F.array_except("items", "tokens")) == 0)
            counts = cut(had.groupBy("items", "of").agg(F.count("*").alias("n"), F.count_if("bad").alias("b")).filter((F.col("b") >= least) & (F.col("n") < F.col("of"))).select("items", "n", "b"), "url-counts")
            rules, alive = rules.unionByName(counts.filter(strong)), counts.filter(~strong)
    numbered = rules.select((F.col("b") / F.col("n")).alias("confidence"), F.col("n").alias("support"), "items", F.array().cast("array<string>").alias("done"))
    same = tokens_.select(F.col("one").alias("first"), F.col("token").alias("other"))
    while numbered.filter(F.size("items") > 0).limit(1).count():  # each token stands for all that the same URLs have
        step = numbered.filter(F.size("items") > 0).withColumn("first", F.element_at("items", 1)).join(broadcast_if_small(same), "first")
        numbered = cut(numbered.filter(F.size("items") == 0).unionByName(step.select("confidence", "support", F.slice("items", 2, 1 << 20).alias("items"), F.concat("done", F.array("other")).alias("done"))), "url-spread")
    keyed = numbered.select(F.array_sort("done").alias("items"), "confidence", "support").withColumn("token", F.explode("items")).join(tokens_.select("token", "n"), "token").groupBy("items", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    return cut(keyed.select("items", "key", "confidence", "support"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: tokens and a key column `of`. of, rule_items, confidence, support of every rule whose items a URL has all."""
    index = rules.select(F.col("key").alias("token"), F.col("items").alias("rule_items"), "confidence", "support")
    return (urls.select("of", "tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(index, 100_000), "token")
            .filter(F.size(F.array_except("rule_items", "tokens")) == 0).select("of", "rule_items", "confidence", "support"))


def judge(pages: DataFrame, labels: DataFrame, places: tuple[Place, ...] = PLACES, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, pattern.

    labels (doc_id, quality, toxic): a page is bad if its id has a label of quality 0 or toxic 1. verdict is the place's, else block if a rule
    matches, else allow; pattern is the matching rule of the highest confidence (then support, then items), null if there is none. A null url lies
    nowhere and matches nothing.
    """
    urls = split(pages.select("page_id", "url")).withColumn("tokens", tokens())
    bad = labels.select("doc_id", "quality", "toxic").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    rules = mine(urls.join(bad, "page_id"), support, confidence)
    best = match(urls.select("tokens", F.struct("page_id", "url").alias("of")).distinct(), rules).groupBy("of").agg(F.max(F.struct("confidence", "support", F.array_join("rule_items", " ").alias("pattern")))["pattern"].alias("pattern"))
    best = best.select(F.col("of.page_id").alias("_p"), F.col("of.url").alias("_u"), "pattern")
    joined = urls.join(best, F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")), "left").withColumn("place", place(F.col("host"), F.col("path"), places))
    return joined.select("page_id", "host", "path", F.col("place.rule").alias("rule"), F.coalesce("place.verdict", F.when(F.col("pattern").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "pattern")


_SQL_PLACES = " ".join(f"WHEN (host = '{p.host}' OR ends_with(host, '.{p.host}')) AND starts_with(path, '{p.path}') THEN '{p.name}|{p.verdict}'" for p in sorted(PLACES, key=lambda p: (len(p.name), p.name), reverse=True))
_SQL_TYPED = "list_transform(list_filter({}, lambda x: x <> ''), lambda x: '{}:' || x)"
_SQL_NUMBER = "regexp_replace({}, '[0-9]+', '#', 'g')"
#: DuckDB SQL for judge(): all subsets of the labelled URLs' tokens are counted, which takes URLs of up to some 20 tokens.
ORACLE = rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, lower(coalesce(url, '')) AS low FROM pages),
h AS (SELECT page_id, url, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT page_id, url, host, path, CASE {_SQL_PLACES} END AS place, list_sort(list_distinct(list_concat({_SQL_TYPED.format("[regexp_extract(low, '^([a-z]+)://', 1)]", "s")}, {_SQL_TYPED.format("string_split(" + _SQL_NUMBER.format("host") + ", '.')", "h")},
  {_SQL_TYPED.format("string_split_regex(" + _SQL_NUMBER.format("lower(path)") + ", '[/._-]+')", "p")}, {_SQL_TYPED.format("list_transform(string_split(regexp_extract(low, '[?]([^#]*)', 1), '&'), lambda x: " + _SQL_NUMBER.format("split_part(x, '=', 1)") + ")", "q")}))) AS tokens FROM h),
y AS (SELECT doc_id AS page_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels GROUP BY 1), l AS (SELECT tokens, bad, unnest(range(1, (1 << len(tokens))::BIGINT)) AS m FROM t JOIN y USING (page_id)),
c AS (SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) % 2 = 1) AS items, bad FROM l), n AS (SELECT items, count(*) AS n, sum(bad) AS b FROM c GROUP BY 1),
s AS (SELECT items, b::DOUBLE / n AS confidence, n FROM n WHERE n >= greatest({SUPPORT}, ceil({SUPPORT_SHARE} * (SELECT count(*) FROM t JOIN y USING (page_id) WHERE len(tokens) > 0))) AND b::DOUBLE / n >= {CONFIDENCE}),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE len(z.items) < len(s.items) AND list_has_all(s.items, z.items))),
p AS (SELECT DISTINCT t.page_id, t.url, array_to_string(r.items, ' ') AS pattern, confidence, n FROM (SELECT DISTINCT page_id, url, tokens FROM t) t JOIN r ON list_has_all(t.tokens, r.items)),
best AS (SELECT page_id, url, pattern FROM p QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY confidence DESC, n DESC, pattern DESC) = 1)
SELECT t.page_id, host, path, split_part(place, '|', 1) AS rule, coalesce(split_part(place, '|', 2), CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM t LEFT JOIN best ON best.page_id IS NOT DISTINCT FROM t.page_id AND best.url IS NOT DISTINCT FROM t.url
"""
