"""Approximate nearest neighbours from a stored index of inverted lists.

Centroids are fitted on a bounded sample of the vectors; every vector is written to the list of its nearest centroid, a folder
a list. A query reads the lists of its nearest centroids only. How many those are (`probes`) is fitted on the sample too: the
fewest that would have found a share of `target` of its vectors' neighbours there. Where vectors spread in all directions this
is a large part of the lists, where they cluster a few.

Queries are a table and stay one: each gets a row for each list it asks, lists that none asks are not read, and queries meet
vectors by list, in blocks on either side, so that a list with a third of all vectors is dealt to many tasks, and a task
holds one block of each. k rows a query and block leave it."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import Log
from .word_index import Nearest, ranked

#: Vectors that centroids and probes are fitted on; sampled vectors that ask for probes; lists; rows of a block of vectors and of queries.
SAMPLE, ASKERS, MOST_LISTS, BLOCK, QUERY_BLOCK = 20_000, 256, 1024, 16_384, 16_384
TARGET, NEIGHBOURS = 0.95, 20


def centroids_of(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; a centroid without vectors starts anew at the vector that fits worst."""
    r = np.random.default_rng(1)
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        for j in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(fit.argmin())
            sums[j], fit[worst] = x[worst], np.inf
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fewest_probes(x: np.ndarray, c: np.ndarray, target: float, k: int = NEIGHBOURS) -> int:
    """How many lists, nearest first, hold a share of `target` of the k nearest of each of ASKERS vectors."""
    asks = x[: min(len(x), ASKERS)]
    near = np.argsort(-(asks @ x.T), axis=1, kind="stable")[:, : k + 1]
    own = (x @ c.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asks @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    at = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


class VectorIndex:
    """An index in a folder; vectors are of one length, null ones are left out, ids are unique."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self.log = Log(spark, f"{self.where}/log")

    def refresh(self, vectors: DataFrame, fingerprint: str, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET, most_lists: int = MOST_LISTS) -> VectorIndex:
        """Builds the index unless the stored one is of the same fingerprint."""
        at, entry = self.log.latest()
        if entry.get("fingerprint") == fingerprint:
            return self
        rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<float>").alias("v")).filter("v is not null and vec_id is not null")
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
        if not sample:
            self.log.put(at + 1, {"fingerprint": fingerprint, "folder": "", "centroids": [], "counts": {}, "probes": 0})
            return self
        x = np.array([r.v for r in sample], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        lists = max(1, min(most_lists, len(x), round(rows.count() ** 0.5)))
        c = centroids_of(x, lists)

        def assigned(batches):
            for b in batches:
                own = (_rows(b.column(1)) @ c.T).argmax(axis=1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1)], names=["list", "vec_id", "v"])

        kind = dict(rows.dtypes)["vec_id"]
        folder = f"lists-{uuid.uuid4().hex}"
        # rebalanced, so that a large list is written by several tasks, and many small ones by one
        rows.mapInArrow(assigned, f"list int, vec_id {kind}, v array<float>").hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.where}/{folder}")
        counts = {str(r["list"]): r["n"] for r in self.spark.read.parquet(f"{self.where}/{folder}").groupBy("list").agg(F.count("*").alias("n")).collect()}
        self.log.put(at + 1, {"fingerprint": fingerprint, "folder": folder, "centroids": c.tolist(), "counts": counts, "probes": fewest_probes(x, c, target)})
        return self

    def search(self, queries: DataFrame, k: int, query: str = "query", vector: str = "q", probes: int | None = None, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(query, vec_id, distance, rank): about the k nearest by cosine distance of unit vectors, of the lists that are read."""
        entry = self.log.latest()[1]
        kind = dict(queries.dtypes)[query]
        if not entry["counts"]:
            return self.spark.createDataFrame([], f"query {kind}, vec_id long, distance double, rank int")
        c, n = np.array(entry["centroids"]), min(probes or entry["probes"], len(entry["centroids"]))
        asked = queries.select(F.col(query).alias("query"), F.col(vector).cast("array<float>").alias("q")).filter("q is not null")

        def probed(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    lists = np.argsort(-(_rows(part.column(1)) @ c.T), axis=1, kind="stable")[:, :n]
                    rows = pa.array(np.repeat(np.arange(part.num_rows), n))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows)], names=["list", "query", "q"])

        rows = asked.mapInArrow(probed, f"list int, query {kind}, q array<float>")
        wanted = sorted(r["list"] for r in rows.select("list").distinct().collect())  # at most MOST_LISTS
        blocks = {int(x): -(-m // block) for x, m in entry["counts"].items()}
        of_list = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))
        shares = max(1, -(-queries.count() // query_block))
        held = self.spark.read.parquet(f"{self.where}/{entry['folder']}").filter(F.col("list").isin(wanted))
        held = held.select("list", F.pmod(F.xxhash64("vec_id"), of_list[F.col("list")]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "v")
        rows = rows.filter(F.col("list").isin(list(blocks)))
        rows = rows.select("list", F.explode(F.sequence(F.lit(0), of_list[F.col("list")] - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int").alias("share"), "query", "q")
        of_vec = dict(held.dtypes)["vec_id"]
        out = pa.schema([("query", rows.select("query").limit(0).toArrow().schema.field(0).type), ("vec_id", held.select("vec_id").limit(0).toArrow().schema.field(0).type), ("distance", pa.float64())])

        def nearest(vectors: pa.Table, asks: pa.Table) -> pa.Table:
            if not vectors.num_rows or not asks.num_rows:
                return out.empty_table()
            q, v = _rows(asks.column("q")), _rows(vectors.column("v"))
            best, names = Nearest(len(q), k), np.array(vectors.column("vec_id").to_pylist(), object)
            for lo in range(0, len(q), 1024):
                best.add(names, 1.0 - q[lo : lo + 1024] @ v.T, which=np.arange(lo, min(lo + 1024, len(q))))
            return pa.Table.from_batches(best.batches(asks.column("query").to_pylist(), out.names)).cast(out)

        keys = ["list", "block", "share"]
        met = held.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(nearest, f"query {kind}, vec_id {of_vec}, distance double")
        return ranked(met, ["query"], [F.asc(F.round("distance", 6)), F.asc("vec_id")], k)
