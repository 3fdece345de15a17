"""Readers of the record formats, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType

_S, _L = StringType(), LongType()


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


WORK = _struct(
    id=_S, display_name=_S, title=_S, publication_date=_S, publication_year=_L, cited_by_count=_L, doi=_S, ids=MapType(_S, _S), abstract_inverted_index=MapType(_S, ArrayType(_L)),
    authorships=ArrayType(_struct(author=_struct(id=_S, display_name=_S), institutions=ArrayType(_struct(id=_S, display_name=_S)), raw_affiliation_strings=ArrayType(_S))),
    primary_topic=_struct(id=_S, display_name=_S, subfield=_struct(id=_S, display_name=_S), field=_struct(id=_S, display_name=_S), domain=_struct(id=_S, display_name=_S)), referenced_works=ArrayType(_S))
SNAPSHOT = _struct(id=_S, title=_S, abstract=_S, authors=_S, authors_parsed=ArrayType(ArrayType(_S)), categories=_S, versions=ArrayType(_struct(version=_S, created=_S)), doi=_S, comments=_S, update_date=_S, deleted=BooleanType())


def read_records(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """JSON lines, compressed or not; blank lines are skipped. Broken lines are dropped, or fail the query if strict, with their file and how they begin; `broken_lines` finds where they are."""
    with_bad = StructType([*schema.fields, StructField("_bad", _S)])
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.col("_metadata.file_path").alias("file"))
    whole = F.col("r._bad").isNull()
    if strict:
        said = F.concat(F.lit("broken record in "), F.col("file"), F.lit(": "), F.substring("r._bad", 1, 80))
        whole = F.when(whole, True).otherwise(F.raise_error(said).cast("boolean"))
    return lines.filter(whole).select(*[F.col("r")[c].alias(c) for c in schema.names])


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of the lines that are no JSON objects; blank ones are none. Files that cannot be split, as compressed ones, are counted where they are read, others by how many lines their pieces have."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    pieces = text.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = pieces.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bad = text.filter((F.trim("value") != "") & F.from_json("value", "_bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())
    return bad.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, citationid, isinfluential of citation records under any spelling of the ends; records without an end are left out, broken ones raise."""
    m = F.from_json("value", MapType(_S, _S), {"mode": "FAILFAST"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select(m.alias("m"))
    first = lambda *names: F.coalesce(*[F.col("m")[n] for n in names]).cast("bigint")
    out = rows.select(first("citingcorpusid", "citingCorpusId", "citing_corpus_id", "citingcorpus_id").alias("src"), first("citedcorpusid", "citedCorpusId", "cited_corpus_id", "citedcorpus_id").alias("dst"),
                      first("citationid").alias("citationid"), F.col("m")["isinfluential"].cast("boolean").alias("isinfluential"))
    return out.filter("src is not null and dst is not null")


def last_records(records: DataFrame, key: str, position: str) -> DataFrame:
    from skein.operators.corpus import latest_wins

    return latest_wins(records, [key], position)


OAI = "header struct<identifier:string,datestamp:string,_status:string>, metadata struct<arXiv:struct<id:string,title:string,abstract:string,categories:string,created:string>>"


def parse_oai(records: DataFrame, xml: str = "xml") -> DataFrame:
    """id, datestamp, deleted, title, abstract, categories, primary, created from a column of OAI-PMH <record> elements."""
    r = records.select(F.from_xml(F.col(xml), OAI).alias("r"))
    m = F.col("r.metadata.arXiv")
    return r.select(F.coalesce(m["id"], F.regexp_extract("r.header.identifier", "([^:]+)$", 1)).alias("id"), F.col("r.header.datestamp").alias("datestamp"), F.coalesce(F.col("r.header._status") == "deleted", F.lit(False)).alias("deleted"),
                    m["title"].alias("title"), m["abstract"].alias("abstract"), m["categories"].alias("categories"), F.split(m["categories"], " ")[0].alias("primary"), m["created"].alias("created"))


OAI_PAGE = "error struct<_code:string,_VALUE:string>, ListRecords struct<record:array<struct<" + OAI.replace("header struct", "header:struct").replace("metadata struct", "metadata:struct") + ">>,resumptionToken:struct<_VALUE:string,_cursor:string>>"


def parse_oai_page(pages: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(records as parse_oai gives them, and page state: token, error) of a column of whole OAI-PMH answers. An empty token is null: the list has ended.

    An error answer has no records; `noRecordsMatch` is no error.
    """
    r = pages.select(F.from_xml(F.col(xml), OAI_PAGE).alias("r"))
    rows = r.select(F.explode("r.ListRecords.record").alias("r"))
    m = F.col("r.metadata.arXiv")
    records = rows.select(F.coalesce(m["id"], F.regexp_extract("r.header.identifier", "([^:]+)$", 1)).alias("id"), F.col("r.header.datestamp").alias("datestamp"), F.coalesce(F.col("r.header._status") == "deleted", F.lit(False)).alias("deleted"),
                          m["title"].alias("title"), m["abstract"].alias("abstract"), m["categories"].alias("categories"), F.split(m["categories"], " ")[0].alias("primary"), m["created"].alias("created"))
    code = F.col("r.error._code")
    return records, r.select(F.nullif(F.trim("r.ListRecords.resumptionToken._VALUE"), F.lit("")).alias("token"), F.when(code != "noRecordsMatch", F.concat_ws(": ", code, "r.error._VALUE")).alias("error"))


def write_shards(df: DataFrame, path: str, key: str, size: int) -> None:
    """Parquet in a folder for each range of `size` ids, so that a lookup reads one folder."""
    df.withColumn("shard", F.floor(F.col(key) / size)).repartition("shard").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, files, bytes, sha of each written table: the number and size of its files and a digest of theirs."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        one = files.select("length", F.sha2("content", 256).alias("s")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("s")), ""), 256).alias("sha")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out

