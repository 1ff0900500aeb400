"""Queries of single functions and small sources over the tables' own texts and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions.html import stable_sql
from ..sources import pages as P
from ..sources import tables as S
from .common import quoted, table


def sentence_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's whole text in sentence case, and its first 120 characters as a title phrase."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.sentence_case(F.col("text")), 256).alias("sentence_sha256"), T.title_phrase(F.upper(F.translate(F.substring("text", 1, 120), "ß", "s"))).alias("phrase"))


def draft_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks of a sentence on every part, one of them filled twice, one left."""
    text = F.concat(F.lit("Supply [QUANTITY] of "), "p_name", F.lit(" to [PLACE OF DELIVERY], [QUANTITY] more of "), "p_type")
    values = F.create_map(F.lit("[QUANTITY]"), F.col("p_size").cast("string"), F.lit("[PLACE OF DELIVERY]"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit("")))
    filled = T.fill_placeholders(text, values)
    return table(spark, sf, "part").select("p_partkey", filled.alias("filled"), F.array_join(T.placeholders(text), "|").alias("blanks"), F.array_join(T.placeholders(filled), "|").alias("left"))


def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen options as a text: the name of a part goes, empty and null ones do too."""
    labels = F.array(F.concat(F.lit("Part "), F.col("p_size"), F.lit(" - "), "p_name"), F.lit("  "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.concat(F.lit(" "), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", T.answers_as_text(labels).alias("said"))


def column_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A column's key of the first 60 characters of every text."""
    return table(spark, sf, "documents").select("doc_id", T.column_key(F.substring("text", 1, 60)).alias("key"))


def changed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose hash is not the stored one: a third is stored as it is, a third with another hash, a third not at all."""
    p = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("page"), F.sha2(T.normalise_html(F.col("html")), 256).alias("page_hash"))
    state = p.filter("page_id % 3 < 2").select(F.col("page").alias("key"), F.when(F.col("page_id") % 3 == 0, F.col("page_hash")).otherwise("old").alias("value"))
    return P.changed_pages(p, state).select("page_id", "page_hash")


def verified_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A new catalogue of four parts in five, over an old one of which every fourth row was verified."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("filename"), "p_partkey", "p_name")
    old = p.select("filename", F.concat(F.lit("old "), "p_name").alias("title"), (F.col("p_partkey") % 4 == 0).alias("verified"))
    new = p.filter("p_partkey % 5 <> 0").select("filename", F.concat(F.lit("new "), "p_name").alias("title"), F.lit(False).alias("verified"))
    return S.keep_verified(old, new).select("filename", "title", "verified")


def numbers_of_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index of the standards that categories name."""
    name = F.concat(F.initcap("p_name"), F.lit(" as per IS "), (F.col("p_partkey") % 80_000 + 10_000).cast("string"))
    return S.by_standard_number(table(spark, sf, "part").select(name.alias("name"), I.parse_category(name)["standards"].alias("standards"))).select("number", "name", F.col("pos").cast("long").alias("pos"))


def ttl_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct request against a cache of all, as of the latest: what was fetched last for it within 24 hours."""
    e = table(spark, sf, "events").select(F.concat_ws(" ", "event_type", "props").alias("query"), F.col("ts").cast("timestamp").alias("fetched_at"))
    cache = e.select(S.cache_key(F.col("query")).alias("key"), "fetched_at", F.unix_micros("fetched_at").alias("payload"))
    now = e.agg(F.max("fetched_at")).first()[0]
    return S.cached(e.select("query").distinct(), cache, F.lit(now)).select("query", "key", F.col("payload").cast("string").alias("fetched_us"))


_ACRONYMS = quoted(T.ACRONYMS)
SQL = {
    "sentence_titles": rf"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(COALESCE(text, ''), '\s+', ' ', 'g')), ' ') AS w, trim(regexp_replace(upper(replace(left(text, 120), 'ß', 's')), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(w, lambda x, i: CASE WHEN upper(regexp_replace(x, '^[''"()\[\],.]+|[''"()\[\],.]+$', '', 'g')) IN ({_ACRONYMS}) OR (length(regexp_replace(x, '\P{{L}}', '', 'g')) = 1 AND length(x) <= 3) THEN x WHEN i = 1 THEN upper(x[1]) || lower(x[2:]) ELSE lower(x) END), ' ')) AS sentence_sha256,
CASE WHEN lower(t) <> t THEN array_to_string(list_transform(string_split(t, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') ELSE t END AS phrase FROM d""",
    "draft_blanks": """SELECT p_partkey, 'Supply ' || p_size || ' of ' || p_name || ' to ' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '[PLACE OF DELIVERY]' END || ', ' || p_size || ' more of ' || p_type AS filled,
'PLACE OF DELIVERY|QUANTITY' AS blanks, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'PLACE OF DELIVERY' END AS "left" FROM part""",
    "answer_texts": "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '; ' || p_type ELSE '' END || '; ' || p_brand AS said FROM part",
    "column_keys": r"SELECT doc_id, regexp_replace(regexp_replace(lower(left(text, 60)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM documents",
    "changed_pages": f"SELECT page_id, sha256({stable_sql('html')}) AS page_hash FROM pages WHERE page_id % 3 <> 0",
    "verified_entries": "SELECT CAST(p_partkey AS VARCHAR) AS filename, CASE WHEN p_partkey % 4 = 0 THEN 'old ' ELSE 'new ' END || p_name AS title, p_partkey % 4 = 0 AS verified FROM part WHERE p_partkey % 5 <> 0",
    "numbers_of_categories": "SELECT CAST(p_partkey % 80000 + 10000 AS VARCHAR) AS number, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' as per IS ' || (p_partkey % 80000 + 10000) AS name, 0::BIGINT AS pos FROM part",
    "ttl_cache": """WITH e AS (SELECT event_type || ' ' || props AS query, epoch_us(ts) AS us FROM events), m AS (SELECT MAX(us) AS now FROM e)
SELECT query, left(sha256(lower(trim(query))), 16) AS key, CAST(MAX(us) FILTER (WHERE now - us <= 86400000000) AS VARCHAR) AS fetched_us FROM e, m GROUP BY query""",
}
QUERIES = {f.__name__: f for f in (sentence_titles, draft_blanks, answer_texts, column_keys, changed_pages, verified_entries, numbers_of_categories, ttl_cache)}
