"""The whole change cycle over monitored pages as one run, or as a stream of them.

Landed pages are held against the stored page hashes; the ids that changed pages list are found; those that are new, or whose row has
changed, are targets; records are collected for them and only for them; the change tracker takes the records and withdraws what no
page lists any more, if all changed pages are complete and every id is accounted for. Then what the pages list is stored, and
their hashes last. A run that dies anywhere is done again by the next, and one that is repeated finds nothing to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import discovered_ids
from ..operators.incremental import not_parsed
from ..sources.buckets import BUCKETS, Buckets
from ..sources.pages import changed_pages
from ..stored import durable
from .cdc import Tracker


def listed_ids(pages: DataFrame) -> DataFrame:
    """(page, standard_id, row_hash, complete) of pages (page, html)."""
    return discovered_ids(pages.select(F.col("page").alias("page_id"), "html")).withColumnRenamed("page_id", "page")


class Cycle:
    """State in a folder: pages/ (key, value), listed/ (page, standard_id, row_hash), and the tracker's. `collect` makes records (standard_id, title,
    status, last_amendment_date, position) for a table of ids (standard_id); `discover` finds ids as listed_ids() does."""

    def __init__(self, spark: SparkSession, where: str, collect: Callable[[DataFrame], DataFrame], discover: Callable[[DataFrame], DataFrame] = listed_ids, buckets: int = BUCKETS):
        self.spark, self.collect, self.discover = spark, collect, discover
        where = where.rstrip("/")
        self.pages = Buckets(spark, f"{where}/pages", ["key"], "key string, value string", buckets)
        self.listed = Buckets(spark, f"{where}/listed", ["page", "standard_id"], "page string, standard_id string, row_hash string", buckets)
        self.tracker = Tracker(spark, f"{where}/tracker", buckets)

    def run(self, landed: DataFrame, run_id: str) -> dict[str, int | str]:
        """landed: (page, html, page_hash), a row a page. Gives the run's counts and how it ended."""
        changed = durable(changed_pages(landed, self.pages.read()))
        n = changed.count()
        if not n:
            return {"status": "NO_CHANGE", "pages": 0, "targets": 0, "missing": 0}
        found = durable(self.discover(changed.select("page", "html")))
        held, current = self.listed.read(), self.tracker.current()
        as_before = found.join(held, ["page", "standard_id", "row_hash"], "left_semi").join(current.filter("is_active = 1").select("standard_id"), "standard_id", "left_semi")
        target = durable(found.join(as_before.select("page", "standard_id"), ["page", "standard_id"], "left_anti").select("standard_id").distinct())
        records = durable(self.collect(target).join(target, "standard_id", "left_semi"))
        missing = durable(not_parsed(target, records, "standard_id"))
        # what any page lists now: the changed ones by this run, the others as stored
        listed = found.select("standard_id").unionByName(held.join(changed.select("page"), "page", "left_anti").select("standard_id")).distinct()
        complete = found.filter("not complete").isEmpty() and not found.isEmpty()
        status = self.tracker.run(records, run_id, complete=complete, page_hash=run_id, expected=listed, records=records)
        good = found.join(missing, "standard_id", "left_anti")
        whole = found.groupBy("page").agg(F.min(F.col("complete").cast("int")).alias("whole")).filter("whole = 1").select("page")
        gone = held.join(whole, "page", "left_semi").join(found, ["page", "standard_id"], "left_anti").select("page", "standard_id")
        self.listed.write(good.select("page", "standard_id", "row_hash"), gone)
        # a page with ids that no record came back for is looked at again
        again = found.join(missing, "standard_id", "left_semi").select("page").distinct()
        self.pages.write(changed.join(again, "page", "left_anti").select(F.col("page").alias("key"), F.col("page_hash").alias("value")))
        return {"status": status, "pages": n, "targets": target.count(), "missing": missing.count()}

    def stream(self, landed: DataFrame, checkpoint: str) -> StreamingQuery:
        """A run a micro-batch of landed_pages(stream=True); of a page that landed twice in a batch one stays."""

        def batch(df: DataFrame, n: int) -> None:
            self.run(df.dropDuplicates(["page"]), f"{n:012d}")

        return landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
