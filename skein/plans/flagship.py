"""The flagship: facets, dates, citation floor and order in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import citation_floor
from skein.plans.filters import FilterSpec
from skein.plans.registry import Registry
from skein.plans.tables import EDGES, PAPERS, edges, papers

query = Registry()


@query(f"WITH {PAPERS}, {EDGES}, n AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1) SELECT p.node, p.topic, p.date, greatest(p.cited // 20, coalesce(n.n, 0))::BIGINT AS cited_by FROM papers p LEFT JOIN n USING (node) WHERE p.topic = '1-URGENT' AND p.date BETWEEN '1996-01-01' AND '1999-12-31' ORDER BY cited_by DESC, node LIMIT 500")
def flagship_top_papers(spark: SparkSession, d: str) -> DataFrame:
    """Filters reach the scan; only the papers that are left meet the citation counts."""
    spec = FilterSpec(values={"topic": ["1-URGENT"]}, ranges={"date": ("1996-01-01", "1999-12-31")})
    some = spec.apply(papers(spark, d), {})
    own = some.select("node", F.floor(F.col("cited") / 20).alias("cited"))
    near = edges(spark, d).join(some.select(F.col("node").alias("dst")), "dst", "left_semi")
    floor = citation_floor(own, spark.createDataFrame([], "node bigint, provided bigint"), near)
    return floor.join(some.select("node", "topic", "date"), "node").select("node", "topic", "date", "cited_by").orderBy(F.desc("cited_by"), "node").limit(500)
