"""Pages read by a recogniser from outside, each once: texts are kept by the hash of the page's content and its language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unused
from ..stored import durable
from .buckets import BUCKETS, Buckets

#: Texts (null where a page cannot be read) of pages' contents and languages.
Recogniser = Callable[[list[bytes], list[str]], list[str | None]]


class Recognised:
    """A cache in a folder: (content_hash, language, text, run)."""

    def __init__(self, spark: SparkSession, where: str, make: Callable[[], Recogniser], buckets: int = BUCKETS, rows: int = 16):
        self.make, self.rows = make, rows
        self.cache = Buckets(spark, where, ["content_hash", "language"], "content_hash string, language string, text string, run string", buckets)

    def read(self, pages: DataFrame, run: str = "", content: str = "content", language: str = "language") -> DataFrame:
        """Adds ocr_text to pages. Of pages that the cache lacks, one of each content and language goes to the recogniser, which is made once in a
        task; what it reads is stored in one version, what it cannot read is null and is tried again another time."""
        key, named = unused(pages, "__hash", "__language")
        marked = pages.withColumn(key, F.sha2(F.coalesce(F.col(content), F.lit(b"")), 256)).withColumn(named, F.coalesce(F.col(language), F.lit("")))
        asked = marked.select(F.col(key).alias("content_hash"), F.col(named).alias("language"), F.col(content).alias("content")).filter("content is not null")
        todo = asked.join(self.cache.read().select("content_hash", "language"), ["content_hash", "language"], "left_anti").dropDuplicates(["content_hash", "language"])
        make, rows = self.make, self.rows

        def recognise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = None
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    b = whole.slice(at, rows)
                    reader = reader or make()
                    texts = reader(b.column(2).to_pylist(), b.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["content_hash", "language", "text"])

        # written out before it is counted, so that no page is read twice
        new = durable(todo.mapInArrow(recognise, "content_hash string, language string, text string").filter("text is not null"))
        if not new.isEmpty():
            self.cache.write(new.withColumn("run", F.lit(run)))
        known = self.cache.read().select(F.col("content_hash").alias(key), F.col("language").alias(named), F.col("text").alias("ocr_text"))
        return marked.drop("ocr_text").join(known, [key, named], "left").drop(key, named)
