"""Ingestion that can be stopped anywhere: files are decided on, cut into chunks, stored, and only then listed as done.

A run, or a micro-batch of a stream, goes: decide by the manifest and the hashes that stored chunks carry; cut the files to ingest;
put their chunks, with the file's hash and their number on each; remove the ones that carry another; list the files in the manifest.
A run that dies before the chunks are there has changed nothing; one that dies before the old ones are gone leaves files of two
hashes or numbers, which are cut again; one that dies after it finds, next time, chunks that answer for their files, and only
lists them. Both tables are in buckets, so a run touches the buckets of its files only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import gone_files, ingest_decision, inventory
from ..sources.buckets import BUCKETS, Buckets
from ..stored import durable

#: Files to ingest up to which their names, hashes and numbers of pieces go to every task, so that the texts of all files are not shuffled to meet them.
MOST_NAMED = 500_000


class Ingest:
    """chunks: (source, chunk_id, text, source_sha256, source_chunks), manifest: (source, sha256, chunks), in a folder. `cut` makes
    (source, chunk_id, text) of files (source, sha256, ...)."""

    def __init__(self, spark: SparkSession, where: str, cut: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.cut = spark, cut
        self.chunks = Buckets(spark, f"{where.rstrip('/')}/chunks", ["source", "chunk_id"], "source string, chunk_id string, text string, source_sha256 string, source_chunks long", buckets)
        self.manifest = Buckets(spark, f"{where.rstrip('/')}/manifest", ["source"], "source string, sha256 string, chunks long", buckets)

    def inventory(self) -> DataFrame:
        return inventory(self.chunks.read(columns=["source", "source_sha256", "source_chunks"]))

    def decide(self, files: DataFrame) -> DataFrame:
        """files with n_chunks, decision and reason."""
        return ingest_decision(files.select("source", "sha256"), self.manifest.read(), self.inventory())

    def run(self, files: DataFrame, complete: bool = False, prune: bool = False) -> DataFrame:
        """One run; gives what was decided. files: (source, sha256, ...), a row a file. `complete`: they are all there are, so that others are
        gone: their manifest rows go where no chunk is left, and with `prune` their chunks and rows do."""
        decided = durable(self.decide(files))
        todo = decided.filter("decision = 'ingest'").select("source", "sha256")
        n_todo = todo.count()
        if n_todo:
            named = F.broadcast if n_todo <= MOST_NAMED else lambda x: x
            # texts are not shuffled to be picked where all files are to be ingested, or few are
            mine = files.filter("source is not null") if n_todo == decided.count() else files.join(named(todo.select("source")), "source", "left_semi")
            # cut twice, once only to count, so that the pieces' texts are written in one place
            pieces = self.cut(mine).select("source", "chunk_id", "text")
            counted = todo.join(pieces.groupBy("source").agg(F.count("*").alias("chunks")), "source", "left").select("source", "sha256", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))
            counted = durable(counted)
            self.chunks.write(pieces.join(named(counted.withColumnsRenamed({"sha256": "source_sha256", "chunks": "source_chunks"})), "source"))
            now = self.chunks.read(columns=["source", "chunk_id", "source_sha256", "source_chunks"]).join(counted, "source")
            stale = durable(now.filter(~F.col("source_sha256").eqNullSafe(F.col("sha256")) | ~F.col("source_chunks").eqNullSafe(F.col("chunks"))).select("source", "chunk_id"))
            if not stale.isEmpty():
                self.chunks.write(None, stale)
            self.manifest.write(counted)
        # files that chunks vouch for and the manifest does not list so: the run before died between the two
        found = decided.filter("decision = 'skip'").select("source", "sha256", F.col("n_chunks").alias("chunks")).join(self.manifest.read(), ["source", "sha256", "chunks"], "left_anti")
        if not found.isEmpty():
            self.manifest.write(durable(found))
        if complete:
            gone = durable(gone_files(self.inventory(), self.manifest.read(), files.select("source"), prune))
            lost = self.chunks.read(columns=["source", "chunk_id"]).join(gone.filter("action = 'delete'").select("source"), "source", "left_semi")
            if not gone.filter("action = 'delete'").isEmpty():
                self.chunks.write(None, lost)
            if not gone.filter("action <> 'warn'").isEmpty():
                self.manifest.write(None, gone.filter("action <> 'warn'").select("source"))
        return decided

    def stream(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        """A run a micro-batch; a batch that is done again finds its files listed."""

        def batch(df: DataFrame, _: int) -> None:
            self.run(df)

        return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
