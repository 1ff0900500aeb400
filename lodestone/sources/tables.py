"""Table sources and sinks: category lists, catalogues, graphs, manifests, caches, versioned writes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators.incremental import rows_hash
from .buckets import Conflict, Log

CATALOG = "filename string, standard_id string, title string, status string, publication_date string, edition string, last_amendment_date string, doc_type string, number string, part string, part_to string, section string, reaffirmed_year string, confidence string, confidence_score int, needs_review boolean, verified boolean, notes array<string>"
EDGE = "src string, from_file string, to_number string, to_part string, to_section string, cited_year string, cited_title string, role string, page int, confidence string, source string, context string"
REPORT = "filename string, total_pages int, total_chars int, ocr_pages int, empty_pages int, legacy_font_pages int, boilerplate_chars_removed int, chunks int"
MANIFEST = "source string, sha256 string, chunks long, standard_id string, ingested_at string"
METADATA_FIELDS = ["standard_id", "title", "status", "publication_date", "edition", "last_amendment_date", "doc_type", "number", "part", "section"]
TTL_HOURS = 24.0


def categories(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the columns Name, URL and Created At, a byte-order mark allowed; names are parsed."""
    c = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    c = c.toDF(*(x.lstrip("﻿") for x in c.columns))
    return c.select(I.parse_category(F.col("Name")).alias("c"), F.col("URL").alias("url"), F.col("Created At").alias("created_at")).select("c.*", "url", "created_at")


def by_standard_number(cats: DataFrame) -> DataFrame:
    """Inverted index (number, name, position in its category)."""
    return cats.select("name", F.posexplode("standards").alias("pos", "s")).select(F.col("s.number").alias("number"), "name", "pos")


def _json(spark: SparkSession, path: str, schema: str, strict: bool, missing_ok: bool = True) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if not missing_ok or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Missing: empty. Invalid: an error when it is read."""
    return _json(spark, path, CATALOG, strict=True)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of a file; none where it is missing."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string")


def graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges as rows, or nested under `edges` in one object (their source under `from`). Missing or invalid: no edges."""
    fields = EDGE.replace("src string", "`from` string").replace(" int", ": int").replace(" string", ": string")
    nested = _whole(spark, path).select(F.explode(F.from_json("value", f"edges array<struct<{fields}>>")["edges"]).alias("e")).select("e.*").withColumnRenamed("from", "src")
    return _json(spark, path, EDGE, strict=False).filter("src is not null or to_number is not null").unionByName(nested)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows, or as one object with an entry for each file's name. Missing, invalid or a bare list of names: empty."""
    entry = "map<string,struct<sha256:string,chunks:bigint,standard_id:string,ingested_at:string>>"
    whole = _whole(spark, path).filter(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", entry)).alias("source", "e")).filter("e.sha256 is not null").select("source", "e.*")
    return _json(spark, path, MANIFEST, strict=False).filter("source is not null").unionByName(whole)


def report(spark: SparkSession, path: str, fields: str = REPORT) -> DataFrame:
    """The files of a report, from its list `files`. Missing, invalid or of another shape: empty."""
    typed = fields.replace(" int", ": int").replace(" string", ": string")
    return _whole(spark, path).select(F.explode(F.from_json("value", f"files array<struct<{typed}>>")["files"]).alias("f")).select("f.*").filter("filename is not null")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    c = spark.read.schema("cases array<struct<id:string,query:string,expected:string>>").option("multiLine", True).json(path)
    return c.select(F.explode("cases").alias("c")).select("c.*")


def chunk_metadata(files: DataFrame, cat: DataFrame) -> DataFrame:
    """files (filename, ...) with the catalogue's ten fields: empties to null, all as text, the file name where there is
    no id. The catalogue is one row a file; Spark broadcasts it where its size allows."""
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in METADATA_FIELDS]
    return files.join(cat.select("filename", *fields), "filename", "left").withColumn("standard_id", F.coalesce("standard_id", "filename"))


def keep_verified(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new catalogue, but rows that were verified stay as they were."""
    kept = old.filter("verified")
    return new.join(kept.select("filename"), "filename", "left_anti").unionByName(kept.join(new.select("filename"), "filename", "left_semi"), allowMissingColumns=True)


def cache_key(query: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(query)), 256), 1, 16)


def cached(queries: DataFrame, cache: DataFrame, as_of: Column, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """queries: (query, ...), cache: (key, fetched_at, payload). Adds payload, null where the entry is older than the TTL."""
    age = (as_of.cast("double") - F.col("fetched_at").cast("double")) / 3600
    live = cache.filter(age <= ttl_hours).groupBy("key").agg(F.max_by("payload", "fetched_at").alias("payload"))
    return queries.withColumn("key", cache_key(F.col("query"))).join(live, "key", "left")


def corpus_fingerprint(chunks: DataFrame, manifest_rows: DataFrame) -> str:
    """A hash of the number of chunks and of the manifest's rows, whatever their order."""
    return hashlib.sha256(f"{chunks.count()}|{rows_hash(manifest_rows, sorted(manifest_rows.columns))}".encode()).hexdigest()


def valid_documents(docs: DataFrame, most: int = 100, most_id: int = 200, most_text: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) of (id, content)."""
    reason = F.when(F.coalesce(F.length("id"), F.lit(0)) == 0, "no id").when(F.length("id") > most_id, "id too long").when(F.coalesce(F.length("content"), F.lit(0)) == 0, "no content").when(F.length("content") > most_text, "content too long")
    d = docs.withColumn("reason", reason)
    if d.limit(most + 1).count() > most:
        return d.limit(0).drop("reason"), d.withColumn("reason", F.lit("too many documents"))
    return d.filter("reason is null").drop("reason"), d.filter("reason is not null")


class Versions:
    """A table as folders, and a log of which is current. A version is put after its folder is whole, and only if no other writer has
    put one of that number: the other's then stays the version before."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self.log = Log(spark, f"{self.where}/log")

    def current(self) -> int | None:
        return self.log.latest()[0] or None

    def read(self, schema: str | None = None) -> DataFrame | None:
        v, entry = self.log.latest()
        if not v:
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.parquet(f"{self.where}/{entry['folder']}")

    def write(self, df: DataFrame, partition_by: str | None = None, upto: int | None = None) -> int:
        """The new version. With `upto` (0: none yet), fails with Conflict unless that is still the current one."""
        folder = f"data-{uuid.uuid4().hex}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(f"{self.where}/{folder}")
        while True:
            v = self.log.latest()[0]
            if upto is not None and v != upto:
                raise Conflict(f"version {v} was written after {upto}")
            if self.log.put(v + 1, {"folder": folder}):
                return v + 1


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json_text(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2)
