"""Change tracking as a stream: each micro-batch is one run over a page's rows, kept in a table of buckets (sources.buckets).

A run goes: compare the page hash with the stored one; if equal, stop. Else upsert the rows, write the delta, withdraw
what a complete page no longer lists. Rows, hash and the run's name become current in one version, so that a run that fails is
done again, one that is repeated changes nothing, and of two at once the second sees the first (Conflict, or another attempt).
Only buckets of rows that the run has seen or withdrawn are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.buckets import BUCKETS, Buckets, Conflict
from ..operators.incremental import delta_log, row_fingerprint, rows_hash, upsert, withdrawals

COLUMNS = ["title", "status", "last_amendment_date"]
CURRENT = "standard_id string, title string, status string, last_amendment_date string, fingerprint string, is_active int, first_seen string, last_seen string"
RUNS = "run_id string, page_hash string, status string, processed long"


class Tracker:
    """State in a folder: current/ (the table), delta/, runs/. Of runs, those whose version is there have happened."""

    def __init__(self, spark: SparkSession, where: str, buckets: int = BUCKETS):
        self.spark, self.where = spark, where.rstrip("/")
        self.table = Buckets(spark, f"{self.where}/current", ["standard_id"], CURRENT, buckets)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.where}/{name}")
        except Exception as e:  # the folder is not there before the first run
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def last_run(self) -> tuple[str | None, str | None]:
        """(run_id, page_hash) of the last run that finished with a change."""
        n = self.table.notes()
        return n.get("run_id"), n.get("page_hash")

    def current(self) -> DataFrame:
        return self.table.read()

    def deltas(self) -> DataFrame:
        """The deltas of runs that have happened."""
        all_ = self._read("delta", "run_id string, standard_id string, change_type string, old_fingerprint string, new_fingerprint string")
        if not self.table.version():
            return all_.limit(0)
        done = self.spark.read.schema("notes struct<run_id: string>").json(self.table.log.where).select("notes.run_id").distinct()
        return all_.join(done, "run_id", "left_semi")

    def run_states(self) -> DataFrame:
        """(run_id, status): the last state that each run was logged in; RUNNING where it ended without a word."""
        order = F.array_position(F.array(*map(F.lit, ("RUNNING", "FAILED", "NO_CHANGE", "CHANGED"))), F.col("status"))
        return self.runs().groupBy("run_id").agg(F.max_by("status", order).alias("status"))

    def run(self, rows: DataFrame, run_id: str, complete: bool = True, page_hash: str | None = None, attempts: int = 3, expected: DataFrame | None = None, records: DataFrame | None = None) -> str:
        """rows: (standard_id, title, status, last_amendment_date, position). Logs RUNNING, then how it ended, and gives that. A run that
        fails is logged as FAILED and raises; the page's hash does not advance, so the next run does it again. A run that finds
        another one's version under way starts again from it, `attempts` times in all. `expected` (standard_id): what is listed, where that is more than
        the run's rows; with `records`, nothing is withdrawn while an expected id is neither held nor among them."""
        self._log(run_id, page_hash or "", "RUNNING", 0)
        try:
            for left in range(attempts - 1, -1, -1):
                try:
                    return self._run(rows, run_id, complete, page_hash, expected, records)
                except Conflict:
                    if not left:
                        raise
        except Exception:
            self._log(run_id, page_hash or "", "FAILED", 0)
            raise
        raise ValueError("no attempts")

    def _run(self, rows: DataFrame, run_id: str, complete: bool, page_hash: str | None, expected: DataFrame | None = None, records: DataFrame | None = None) -> str:
        if page_hash is None:
            page_hash = rows_hash(rows, ["standard_id", *COLUMNS])
        at, (last, held) = self.table.version(), self.last_run()
        if page_hash == held:
            # the run itself, done before, or one that has nothing new
            return self._log(run_id, page_hash, "CHANGED" if last == run_id else "NO_CHANGE", 0)
        now = rows.withColumn("fingerprint", row_fingerprint("standard_id", *COLUMNS)).withColumn("seen_at", F.lit(run_id))
        before = self.current()
        changes = upsert(before, now, "standard_id", COLUMNS)
        gone = withdrawals(before, now if expected is None else expected, "standard_id", complete, records).select("standard_id", "change_type", F.col("fingerprint").alias("old_fingerprint"), "fingerprint")
        delta_log(changes, "standard_id", run_id).unionByName(delta_log(gone, "standard_id", run_id)).write.mode("overwrite").parquet(f"{self.where}/delta/run={run_id}")
        left = changes.join(gone.select("standard_id", F.lit(1).alias("gone")), "standard_id", "left")
        out = left.withColumn("is_active", F.when(F.col("gone") == 1, 0).otherwise(F.col("is_active"))).withColumn("status", F.when(F.col("gone") == 1, "WITHDRAWN").otherwise(F.col("status")))
        seen = out.filter("change_type <> 'KEPT' or gone = 1").select(*(c.split()[0] for c in CURRENT.split(", ")))
        self.table.write(seen, upto=at, notes={"run_id": run_id, "page_hash": page_hash})
        return self._log(run_id, page_hash, "CHANGED", now.count())

    def _log(self, run_id: str, page_hash: str, status: str, n: int) -> str:
        self.spark.createDataFrame([(run_id, page_hash, status, n)], RUNS).write.mode("append").parquet(f"{self.where}/runs")
        return status

    def stream(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """One run a micro-batch; a batch that is replayed has the same run_id and changes nothing."""
        return source.writeStream.foreachBatch(lambda df, n: self.run(df, f"{n:012d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
