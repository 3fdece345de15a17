"""Records of works to corpus rows: lineage, authorships, scope, registries, identifiers of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import numeric_id, short_id

LEVELS = ("domain", "field", "subfield")


def topic_lineage(topic: str, levels: tuple[str, ...] = LEVELS) -> list[Column]:
    """topic_id, topic and, per level, <level>_id and <level> of a topic struct (id, display_name, and a struct of the same per level). Ids are numbers, -1 where there is none."""
    pair = lambda at, name: [numeric_id(F.col(f"{at}.id")).alias(f"{name}_id"), F.col(f"{at}.display_name").alias(name)]
    out = pair(topic, "topic")
    for level in levels:
        out += pair(f"{topic}.{level}", level)
    return out


def ordered_distinct(arrays: Column) -> Column:
    """The different elements of an array of arrays in order of first occurrence; null elements are left out."""
    return F.array_distinct(F.array_compact(F.flatten(arrays)))


def parse_work(works: DataFrame, orgs: DataFrame) -> DataFrame:
    """Works (id, title, authorships as in readers.WORK) with an id and a title: id, title, author_ids, author_names, institution_ids, evidence.

    Institutions are different ones in order. evidence maps each organisation (orgs: institution, org) to the affiliation strings of those authorships alone that name one of
    its institutions, so none leaks to another organisation of the same work. Works without authorships have empty arrays and an empty map.
    """
    w = works.withColumn("id", short_id(F.col("id"))).filter("id is not null and trim(coalesce(title, '')) <> ''")
    a = F.coalesce("authorships", F.array().cast(dict(works.dtypes)["authorships"]))
    inst = lambda x: F.transform(F.coalesce(x["institutions"], F.array().cast("array<struct<id:string,display_name:string>>")), lambda i: short_id(i["id"]))
    base = w.select("id", "title", F.transform(a, lambda x: short_id(x["author"]["id"])).alias("author_ids"), F.transform(a, lambda x: x["author"]["display_name"]).alias("author_names"), ordered_distinct(F.transform(a, inst)).alias("institution_ids"))
    each = w.select("id", F.posexplode(F.transform(a, lambda x: F.struct(inst(x).alias("i"), F.coalesce(x["raw_affiliation_strings"], F.array().cast("array<string>")).alias("s")))).alias("k", "x"))
    named = each.select("id", "k", "x.s", F.explode(F.array_distinct("x.i")).alias("institution")).join(orgs.select("institution", "org"), "institution").select("id", "k", "org", "s").distinct()
    proof = named.groupBy("id", "org").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x")).select("id", "org", ordered_distinct(F.transform("x", lambda y: y["s"])).alias("s"))
    maps = proof.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("org", "s")))).alias("evidence"))
    return base.join(maps, "id", "left").withColumn("evidence", F.coalesce("evidence", F.create_map().cast("map<string,array<string>>")))


def unit_evidence(papers: DataFrame, units: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """org, unit, node: papers (node, evidence: JSON of organisation to affiliation strings), each string under the first unit (name, pattern) of its organisation that it fits."""
    rows = papers.select("node", F.explode(F.from_json("evidence", "map<string,array<string>>")).alias("org", "s")).select("node", "org", F.explode("s").alias("text"))
    unit = F.coalesce(*[F.when((F.col("org") == o) & F.col("text").rlike(p), F.lit(u)) for o, rules in units.items() for u, p in rules], F.lit(None).cast("string"))
    return rows.select("org", unit.alias("unit"), "node").filter("unit is not null").distinct()


def in_scope(categories: Column, exact: list[str], prefixes: list[str]) -> Column:
    """The categories (array) that are in `exact` or begin with one of `prefixes`; an empty prefix admits all."""
    fits = lambda c: F.coalesce(c.isin(exact) if exact else F.lit(False), F.lit(False)) | (F.exists(F.array(*map(F.lit, prefixes)), lambda p: c.startswith(p)) if prefixes else F.lit(False))
    return F.filter(categories, fits)


def primary_category(categories: Column, exact: list[str], prefixes: list[str]) -> Column:
    """The first category in scope, else the first of all."""
    return F.coalesce(F.get(in_scope(categories, exact, prefixes), F.lit(0)), F.get(categories, F.lit(0)))


def in_dates(rows: DataFrame, date: str, first: str | None, last: str | None) -> DataFrame:
    """Rows whose ISO date lies in first..last, both included; null bounds are open, rows without a date go if there is a bound."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.col(date) >= first)
    if last is not None:
        keep = keep & (F.col(date) <= last)
    return rows.filter(keep)


def merge_registries(parts: list[DataFrame], key: str, last_wins: bool = True) -> DataFrame:
    """One row per key of registries in order: the last one's, or the first one's. A row without a key is none."""
    cols, out = [c for c in parts[0].columns if c != key], None
    for k, p in enumerate(parts):
        row = p.select(key, *cols).filter(F.col(key).isNotNull()).withColumn("_k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    pick = F.max_by if last_wins else F.min_by
    return out.groupBy(key).agg(pick(F.struct(*cols), "_k").alias("r")).select(key, "r.*")


def first_and_last(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key, first_<value>, last_<value> of the least and the greatest position."""
    return rows.groupBy(key).agg(F.min_by(value, position).alias(f"first_{value}"), F.max_by(value, position).alias(f"last_{value}"))


def flatten_ids(rows: DataFrame, group: str, key: str) -> DataFrame:
    """group, ids: the different keys of each group, in order, joined by commas."""
    return rows.filter(F.col(key).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("ids"))


def institution_list(orgs: DataFrame) -> DataFrame:
    """institution, org of orgs (org, position, institutions: array): each institution once, with the first organisation that lists it."""
    each = orgs.select("org", "position", F.posexplode("institutions").alias("k", "institution")).filter("institution is not null")
    return each.groupBy("institution").agg(F.min(F.struct("position", "k", "org"))["org"].alias("org"))


def crosswalk_rows(papers: DataFrame, title_chars: int = 300, venue_chars: int = 120) -> DataFrame:
    """papers (corpusid, title, venue, cites, and external ids as a map or none): rows with a corpusid, title and venue cut, null text '', null count 0, arXiv id where there is one."""
    arxiv = F.nullif(F.col("externalids")["ArXiv"], F.lit("")) if "externalids" in papers.columns else F.lit(None).cast("string")
    return papers.filter("corpusid is not null").select("corpusid", F.coalesce(F.substring("title", 1, title_chars), F.lit("")).alias("title"), F.coalesce(F.substring("venue", 1, venue_chars), F.lit("")).alias("venue"), F.coalesce("cites", F.lit(0)).alias("cites"), arxiv.alias("arxiv_id"))


def ids_fingerprint(rows: DataFrame, group: str, key: str, chars: int = 64) -> DataFrame:
    """group, key: sha256 (its first `chars` digits) of each group's ids in order, joined by commas: the name of what was computed for just these ids."""
    return rows.groupBy(group).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ","), 256), 1, chars).alias("key"))


def list_lengths(lists: DataFrame, key: str, values: str) -> DataFrame:
    """key and the length of its list; reads no more of a columnar list than Spark's reader has to."""
    return lists.select(F.col(key).alias("key"), F.size(values).cast("bigint").alias("neighbors"))


def provider_authors(records: DataFrame) -> DataFrame:
    """id, author_ids, author_names, institutions, evidence (JSON) of provider records (id, authorships as in readers.WORK): each author once, with the name at the first place."""
    each = records.select("id", F.posexplode("authorships").alias("k", "x"))
    people = each.select("id", "k", short_id(F.col("x.author.id")).alias("a"), F.col("x.author.display_name").alias("n")).filter("a is not null").groupBy("id", "a").agg(F.min(F.struct("k", "n")).alias("f"))
    authors = people.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("f.k").alias("k"), F.col("a"), F.col("f.n").alias("n")))).alias("x")).select("id", F.transform("x", lambda y: y["a"]).alias("author_ids"), F.transform("x", lambda y: y["n"]).alias("author_names"))
    inst = each.select("id", "k", F.posexplode("x.institutions").alias("j", "i"), F.col("x.raw_affiliation_strings").alias("s")).select("id", "k", "j", short_id(F.col("i.id")).alias("i"), "s").filter("i is not null")
    lists = inst.groupBy("id", "i").agg(F.min(F.struct("k", "j")).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    found = lists.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "i"))), lambda y: y["i"]).alias("institutions"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", "s"))))).alias("evidence"))
    return records.select("id").join(authors, "id", "left").join(found, "id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("{}")))


def enrichment(corpus: DataFrame, active: DataFrame, matches: DataFrame, key: str, replace: list[str], fill: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus enriched by the matches of its keys alone, active with the enriched columns of its keys, coverage: n, matched, share)."""
    from skein.operators.corpus import enrich
    from skein.operators.lookups import propagate

    own = matches.join(corpus.select(key), key, "left_semi")
    full = enrich(corpus, own, key, replace, fill)
    meta = corpus.select(key).join(own.select(key, F.lit(1).alias("hit")), key, "left").agg(F.count("*").alias("n"), F.count("hit").alias("matched"), F.round(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("share"))
    return full, propagate(active, full, key, [*replace, *fill]), meta


def ordered_known(lists: DataFrame, known: DataFrame) -> DataFrame:
    """node, ids: the local ids (known: id, local) of each node's list (node, position, id) in order of first position, unknown ones dropped."""
    first = lists.join(known, "id").groupBy("node", "local").agg(F.min("position").alias("position"))
    return first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("position", "local"))).alias("x")).select("node", F.transform("x", lambda x: x["local"]).alias("ids"))
