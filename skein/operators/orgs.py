"""Organisations: patterns in affiliation strings, rollups, rosters, directory, names, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.staging import spread, staged


def first_unit(texts: DataFrame, keys: list[str], units: list[tuple[str, str]]) -> DataFrame:
    """keys and unit: per text, the first unit (name, pattern; specific ones first) whose pattern it has. Texts without one have no row."""
    return texts.select(*keys, F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(u)) for u, p in units]).alias("unit")).filter("unit is not null").distinct()


def all_matches(texts: DataFrame, keys: list[str], rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """keys and unit: every organisation (name, pattern, veto) whose pattern a text has and whose veto it has not."""
    hits = [F.when(F.col("text").rlike(p) & (~F.col("text").rlike(v) if v else F.lit(True)), F.lit(u)) for u, p, v in rules]
    return texts.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("unit")).distinct()


def name_only_table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """key, display_name, kind of organisations known by name alone, as a table of the code's rows. ValueError if a key comes twice or is empty."""
    keys = [r[0] for r in rows]
    if len(set(keys)) != len(keys) or not all(keys):
        raise ValueError("keys must be there and differ")
    return spark.createDataFrame(rows, "key string, display_name string, kind string")


def org_papers(institutions: DataFrame, named: DataFrame) -> DataFrame:
    """org, node, direct: each organisation's papers (org, node) by its institutions or by name once; direct if an institution gives them."""
    both = institutions.select("org", "node", F.lit(1).alias("d")).unionByName(named.select("org", "node", F.lit(0).alias("d")))
    return both.groupBy("org", "node").agg(F.max("d").alias("direct"))


def org_rollup(institutions: DataFrame, named: DataFrame) -> DataFrame:
    """org, papers, direct, extracted: numbers of an organisation's papers, of those by institution, and of those by name alone."""
    return org_papers(institutions, named).groupBy("org").agg(F.count("*").alias("papers"), F.sum("direct").alias("direct"), (F.count("*") - F.sum("direct")).alias("extracted"))


def evidence_units(units: DataFrame, papers: DataFrame) -> DataFrame:
    """org, unit, papers: units (org, unit, node) among their organisation's papers (org, node) alone; a unit without one is left out."""
    return units.select("org", "unit", "node").distinct().join(papers.select("org", "node").distinct(), ["org", "node"]).groupBy("org", "unit").agg(F.count("*").alias("papers"))


def roster_orgs(existing: DataFrame, organisations: DataFrame, claims: DataFrame) -> DataFrame:
    """key, papers, methods of roster organisations (key, ...) by their claimed papers (org, node, method); methods are sorted. ValueError if a key exists (key) already or twice."""
    if organisations.join(existing.select("key"), "key", "left_semi").limit(1).count() or organisations.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("a roster organisation's key exists already")
    found = claims.groupBy(F.col("org").alias("key")).agg(F.count_distinct("node").alias("papers"), F.array_sort(F.collect_set("method")).alias("methods"))
    return organisations.select("key").join(found, "key", "left").select("key", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def named_orgs(existing: DataFrame, table: DataFrame, named: DataFrame) -> DataFrame:
    """key, papers, methods of organisations known by name alone (key) that have papers (org, node); where the key exists (key), that one stays."""
    found = named.groupBy(F.col("org").alias("key")).agg(F.count_distinct("node").alias("papers"))
    return table.select("key").join(existing.select("key"), "key", "left_anti").join(found, "key").select("key", "papers", F.array(F.lit("affiliation_name")).alias("methods"))


def directory(institutions: DataFrame, curated: DataFrame, registry: DataFrame, least: int = 3) -> DataFrame:
    """key (`oa:` and the institution), name, kind, papers of institutions (institution, node) that are not curated (institution) and have `least` papers or more.

    registry: institution, display_name, type; the name is the institution's id where it has none, the kind `other` for unknown types.
    """
    n = institutions.join(curated.select("institution"), "institution", "left_anti").groupBy("institution").agg(F.count_distinct("node").alias("papers")).filter(F.col("papers") >= least)
    kind = F.when(F.col("type").isin("education", "company", "government", "facility", "nonprofit", "healthcare", "archive"), F.col("type")).otherwise("other")
    return n.join(registry.select("institution", "display_name", "type"), "institution", "left").select(F.concat(F.lit("oa:"), "institution").alias("key"), F.coalesce("display_name", "institution").alias("name"), kind.alias("kind"), "papers")


def new_pairs(extracted: DataFrame, asserted: DataFrame) -> DataFrame:
    """Distinct extracted pairs (node, org) that are not asserted."""
    return extracted.select("node", "org").distinct().join(asserted.select("node", "org"), ["node", "org"], "left_anti")


def node_labels(institutions: DataFrame, registry: DataFrame, named: DataFrame, names: DataFrame, rows: int = 0) -> DataFrame:
    """node, label: display names of a paper's institutions (institution, node; registry: institution, display_name) and of the organisations that its strings name (org, node; names: key, display_name); what has no name is left out.

    rows: how many rows institutions and named have together, about, if they are many; a task of the result holds a bounded number of them then."""
    a = institutions.join(registry.select("institution", "display_name"), "institution").select("node", "display_name")
    b = named.join(names.select(F.col("key").alias("org"), "display_name"), "org").select("node", "display_name")
    all_ = a.union(b).filter("coalesce(display_name, '') <> ''").select("node", F.col("display_name").alias("label"))
    return spread(all_, rows, "node", "label").distinct()


def same_name_groups(authors: DataFrame, least: int = 1) -> DataFrame:
    """name, ids, papers, first_id: authors (id, name, papers) of exactly one name, `least` or more of them."""
    return authors.groupBy("name").agg(F.count("*").alias("ids"), F.sum("papers").alias("papers"), F.min("id").alias("first_id")).filter(F.col("ids") >= least)


def same_identity(authors: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, name of all authors (id, name) who have exactly the name of a chosen one (id)."""
    names = authors.join(chosen.select("id"), "id", "left_semi").select("name").distinct()
    return authors.join(names, "name", "left_semi").select("id", "name")


def one_per_person(authors: DataFrame) -> DataFrame:
    """name, first_id: of authors (id, name) of one name the first."""
    return authors.groupBy("name").agg(F.min("id").alias("first_id"))


def org_of_node(memberships: DataFrame, order: DataFrame) -> DataFrame:
    """node, org: of a paper's organisations (node, org) the first in an order (org, position); those without a place are none."""
    return memberships.join(order.select("org", "position"), "org").groupBy("node").agg(F.min(F.struct("position", "org"))["org"].alias("org"))


def org_tree(orgs: DataFrame, kinds: list[str] | None = None, depth: int = 64) -> DataFrame:
    """id, path, depth of orgs (id, parent, name, and unit_type if `kinds` gives an order of these) from the roots down, level by level.

    path joins the names by `/`. What hangs on a cycle has no root and no row. place orders siblings by unit type, then name.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("unit_type")).cast("int"), F.lit(len(kinds) + 1)) if kinds else F.lit(0)
    rows = orgs.select("id", "parent", "name", kind.alias("_k"))
    rows = staged(rows.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("_k", "name", "id"))), "orgs")
    front = rows.filter("parent is null").select("id", F.col("name").alias("path"), F.lit(0).alias("depth"), "place")
    out = front
    for d in range(1, depth):
        front = staged(rows.join(front.select(F.col("id").alias("parent"), F.col("path").alias("above")), "parent").select("id", F.concat_ws("/", "above", "name").alias("path"), F.lit(d).alias("depth"), "place"), "org-tree")
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out


def affiliation_strings(rows: DataFrame, most: int = 8) -> DataFrame:
    """node, strings: the first `most` different affiliation strings (node, text) of each paper in order."""
    each = rows.filter("text is not null").select("node", "text").distinct()
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("text"))).filter(F.col("k") <= most)
    return first.groupBy("node").agg(F.array_sort(F.collect_list("text")).alias("strings"))


def org_builder(institutions: DataFrame, named: DataFrame, curated: DataFrame, registry: DataFrame, organisations: DataFrame, claims: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """key, kind, papers, methods of the whole organisation index: curated roots, roster and name-only organisations, then the directory of all other institutions.

    institutions: institution, node. named: org, node. curated: key, institution. The others as in roster_orgs, named_orgs and directory.
    """
    direct = institutions.join(curated, "institution").select(F.col("key").alias("org"), "node")
    own = named.join(curated.select(F.col("key").alias("org")).distinct(), "org", "left_semi")
    roots = org_rollup(direct, own).select(F.col("org").alias("key"), F.lit("curated").alias("kind"), "papers", F.array(F.lit("affiliation")).alias("methods"))
    roster = roster_orgs(roots, organisations, claims).withColumn("kind", F.lit("roster"))
    known = roots.select("key").union(roster.select("key"))
    only = named_orgs(known, names, named).withColumn("kind", F.lit("name"))
    rest = directory(institutions, curated, registry, least).select("key", "kind", "papers", F.array(F.lit("affiliation")).alias("methods"))
    return roots.unionByName(roster).unionByName(only).unionByName(rest)
