"""Monitored pages: landed HTML files, the hash gate before any further work, state rows and retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.names import unused

MOST_WAIT = 300.0


def landed_pages(spark: SparkSession, path: str, glob: str = "*.html", stream: bool = False) -> DataFrame:
    """(page, html, page_hash) of HTML files that a fetcher has landed; as a stream, each file once."""
    reader = (spark.readStream if stream else spark.read).option("wholetext", True).option("pathGlobFilter", glob)
    f = reader.schema("value string").format("text").load(path).withColumn("page", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1))
    return f.select("page", F.col("value").alias("html"), F.sha2(T.normalise_html(F.col("value")), 256).alias("page_hash"))


def changed_pages(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages whose hash is not the stored one. state: (key, value) with the page as the key; it is advanced last, by set_state."""
    return pages.join(state.select(F.col("key").alias("page"), F.col("value").alias("page_hash")), ["page", "page_hash"], "left_anti")


def set_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value, updated_at): new rows replace those of the same key."""
    return state.join(new.select("key"), "key", "left_anti").unionByName(new)


Model = Callable[[list[str]], list[tuple[str | None, float | None]]]


def route_scripts(texts: DataFrame, text: str, native: Callable[[], Model], roman: Callable[[], Model], second: Callable[[], Model], least: float = 0.6, rows: int = 256) -> DataFrame:
    """Adds language and score, by script: texts of mostly ASCII letters go to `roman`, of these the ones scored up to `least` to `second`, which
    then answers for them; the others go to `native`. Each function makes its model once in a task; a model gets the texts of
    its route in a batch at once, and its answers go back to their rows, in order. A missing score is no low one, and stays."""
    share = unused(texts, "__roman")[0]
    names = ["language", "score"]
    kept = [c for c in texts.columns if c not in names]
    marked = texts.select(*kept).withColumn(share, T.roman_share(F.col(text)) > 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [make() for make in (native, roman, second)]
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                said, ascii_ = [x or "" for x in b.column(kept.index(text)).to_pylist()], b.column(len(kept)).to_pylist()
                answers: list[tuple] = [(None, None)] * len(said)

                def ask(model: Model, which: list[int]) -> None:
                    if which:
                        for i, found in zip(which, model([said[i] for i in which]), strict=True):
                            answers[i] = found

                ask(models[0], [i for i, x in enumerate(ascii_) if not x])
                ask(models[1], letters := [i for i, x in enumerate(ascii_) if x])
                ask(models[2], [i for i in letters if answers[i][1] is not None and answers[i][1] <= least])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in answers], pa.string()), pa.array([x for _, x in answers], pa.float64())], names=[f"c{i}" for i in range(len(kept) + 2)])

    fields = [*marked.schema.fields[:-1], StructField("language", StringType()), StructField("score", DoubleType())]
    plain = marked.toDF(*(f"c{i}" for i in range(len(kept) + 1))).mapInArrow(run, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]))
    return plain.toDF(*(f.name for f in fields))


def with_retries(run: Callable[[], object], attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of run(); a failure is followed by another attempt after a wait that doubles up to MOST_WAIT seconds."""
    for k in range(attempts):
        try:
            return run()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(min(wait * 2**k, MOST_WAIT))
    raise ValueError("no attempts")
