"""Corpus pipeline: toxic documents go, repetitive ones go, one of each near-duplicate class stays, secrets are
masked, and what is left is packed into token sequences. Each stage's result is written as Parquet and read again.

All stages but the last give the columns of their input back, whatever other columns it has; an empty table gives an
empty table; very long texts are processed whole."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, packing, quality, secrets, toxicity
from lodestone.llm.common import fresh_dir, own_columns, table


#: What stages add for themselves begins with this, so that no column of the documents is replaced or lost.
OWN = "__stage_"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.7 or more. The lexicon is learned from the labelled ones that are not held out.
    Null and empty texts score low and stay, as all do where labels are missing; repeated rows fare alike."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, OWN).filter(F.col(f"{OWN}predicted") == 0).select(*own_columns(docs))


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, null and empty texts among them; repeated rows fare alike."""
    return quality.repetition(docs, OWN).filter(F.col(f"{OWN}kept")).select(*own_columns(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id (then hash of the text) of each class of similar texts, one of repeated
    rows. Null and empty texts are one class; a null doc_id goes by the hash of its text."""
    return jaccard_join.one_of_each_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span found, and counts n_chars anew where there is such a column. Null texts stay null."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)), prefix=OWN)
    masked = secrets.redact(F.col("text"), F.col(f"{OWN}all_spans"))
    new = {"text": masked} | ({"n_chars": F.length(masked).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(new[c].alias(c) if c in new else own for c, own in zip(docs.columns, own_columns(docs), strict=True)))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row a piece, with its ids. A null or empty text is its end id alone; only doc_id and
    text are read, and repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_repetitive), ("near_duplicates", one_of_near_copies), ("secrets", mask_secrets), ("packing", pack_tokens)]

#: Learned and hashed stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{where}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
