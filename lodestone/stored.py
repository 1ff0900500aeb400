"""Tables that are read several times, written out once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir named. Only a local
    session without either gets a temporary folder; on a cluster that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        where = context.getCheckpointDir()  # the same at every call
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.replace("file:/", "file:///", 1) if where.startswith("file:/") and not where.startswith("file://") else where


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
