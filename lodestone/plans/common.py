"""Reading tables, and SQL pieces that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens_sql(text: str) -> str:
    """The Unicode word list of a text, as functions.text.tokens gives it."""
    spaced = rf"trim(regexp_replace(lower(COALESCE({text}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
    return f"CASE WHEN {spaced} = '' THEN [] ELSE string_split({spaced}, ' ') END"
