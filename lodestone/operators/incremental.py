"""Incremental ingestion and change tracking: decisions, upserts, withdrawals and merges as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused


def row_fingerprint(*columns: str, separator: str = "") -> Column:
    """SHA-256 of the columns' texts, nulls empty. Without a separator different rows can share a fingerprint."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def inventory(chunks: DataFrame) -> DataFrame:
    """(source, n_chunks, n_stamped, hashes, totals) of chunk metadata (source, source_sha256, source_chunks); no text is read."""
    return chunks.filter("source is not null").groupBy("source").agg(F.count("*").alias("n_chunks"), F.count(F.nullif("source_sha256", F.lit(""))).alias("n_stamped"), F.collect_set(F.nullif("source_sha256", F.lit(""))).alias("hashes"), F.collect_set(F.when(F.nullif("source_sha256", F.lit("")).isNotNull(), F.coalesce("source_chunks", F.lit(-1)))).alias("totals"))


def ingest_decision(files: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """files: (source, sha256); manifest: (source, sha256, chunks); stored: inventory(). Adds decision (skip or ingest) and
    reason. Chunks that carry a hash answer for themselves; the manifest is asked about the others."""
    m = manifest.select("source", F.col("sha256").alias("m_sha"), F.col("chunks").alias("m_chunks"), F.lit(True).alias("listed"))
    j = files.join(m, "source", "left").join(stored, "source", "left")
    n, stamped = F.coalesce("n_chunks", F.lit(0)), F.coalesce("n_stamped", F.lit(0))
    reason = (
        F.when((stamped > 0) & (stamped != n), "mixed")
        .when((stamped > 0) & ((F.size("hashes") != 1) | (F.get("hashes", F.lit(0)) != F.col("sha256"))), "changed")
        .when((stamped > 0) & ((F.size("totals") != 1) | (F.get("totals", F.lit(0)) != n)), "interrupted")
        .when(stamped > 0, "unchanged")
        .when(F.col("listed").isNull() & (n > 0), "unlisted")
        .when(F.col("listed").isNull(), "new")
        .when(~F.col("m_sha").eqNullSafe(F.col("sha256")), "changed")
        .when(~F.col("m_chunks").eqNullSafe(n), F.when(n == 0, "missing").otherwise("interrupted"))
        .otherwise("unchanged")
    )
    return j.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "unchanged", "skip").otherwise("ingest")).select(*files.columns, n.alias("n_chunks"), "decision", "reason")


def repaired_manifest(decided: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds manifest rows for files that the index vouches for but the manifest lacks."""
    new = decided.filter("decision = 'skip'").join(manifest, "source", "left_anti").select("source", "sha256", F.col("n_chunks").alias("chunks"))
    return manifest.unionByName(new)


def pending(decided: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, sha256, reason, old_ids): the files to ingest, with the ids of the chunks that they have now, sorted."""
    ids = chunks.groupBy("source").agg(F.array_sort(F.collect_list("chunk_id")).alias("old_ids"))
    todo = decided.filter("decision = 'ingest'").join(ids, "source", "left")
    return todo.select("source", "sha256", "reason", F.coalesce("old_ids", F.array().cast("array<string>")).alias("old_ids"))


def gone_files(stored: DataFrame, manifest: DataFrame, present: DataFrame, prune: bool = False) -> DataFrame:
    """(source, n_chunks, action): files of the inventory or the manifest that are no longer present."""
    names = stored.select("source").union(manifest.select("source")).distinct().join(present, "source", "left_anti")
    out = names.join(stored.select("source", "n_chunks"), "source", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return out.withColumn("action", F.when(F.col("n_chunks") == 0, "drop_manifest").otherwise("delete" if prune else "warn"))


def upsert_chunks(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace stored ones of the same key: anti-join and union."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def stale(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Classifies both sides' rows as NEW, UPDATED, UNCHANGED or KEPT (not in this run). current has fingerprint, is_active,
    first_seen and `columns`; incoming has fingerprint, seen_at and `columns`. Of incoming rows with one key the last by
    `position` counts. A row that was inactive is UPDATED even with an equal fingerprint; first_seen is kept."""
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*columns, "fingerprint", "seen_at"), "position").alias("n"))
    old = current.select(key, F.struct(*columns, "fingerprint", "is_active", "first_seen", "last_seen").alias("o"))
    j = old.join(last, key, "full_outer")
    kind = F.when(F.col("n").isNull(), "KEPT").when(F.col("o").isNull(), "NEW").when((F.col("o.fingerprint") != F.col("n.fingerprint")) | (F.col("o.is_active") == 0), "UPDATED").otherwise("UNCHANGED")
    pick = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in (*columns, "fingerprint")]
    return j.select(key, kind.alias("change_type"), F.col("o.fingerprint").alias("old_fingerprint"), *pick, F.when(F.col("n").isNotNull(), F.lit(1)).otherwise(F.col("o.is_active")).alias("is_active"), F.coalesce("o.first_seen", "n.seen_at").alias("first_seen"), F.coalesce("n.seen_at", "o.last_seen").alias("last_seen"))


def delta_log(changes: DataFrame, key: str, run_id: str) -> DataFrame:
    return changes.filter("change_type in ('NEW', 'UPDATED', 'WITHDRAWN')").select(F.lit(run_id).alias("run_id"), key, "change_type", "old_fingerprint", F.col("fingerprint").alias("new_fingerprint"))


def expected_ids(current: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """What a run without a discovery expects: all that is held and all that is asked for."""
    return current.select(key).unionByName(target.select(key)).distinct()


def changed_or_missing(found: DataFrame, current: DataFrame, key: str, signature: str) -> DataFrame:
    """(key): discovered ids that are not held, or are held with another signature (null is one too)."""
    old, there = unused(found, "__old", "__held")
    held = current.select(key, F.col(signature).alias(old), F.lit(True).alias(there))
    j = found.join(held, key, "left")
    return j.filter(F.col(there).isNull() | ~F.col(signature).eqNullSafe(F.col(old))).select(key)


def not_parsed(target: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key): ids that were asked for and that no record came back for."""
    return target.select(key).distinct().join(records.select(key), key, "left_anti")


def withdrawals(current: DataFrame, expected: DataFrame, key: str, complete: Column | bool = True, records: DataFrame | None = None) -> DataFrame:
    """Active rows that a complete discovery does not list; an incomplete or empty one withdraws nothing, nor one of whose ids
    some are neither held nor among the run's `records` (where these are given)."""
    flag = F.lit(complete) if isinstance(complete, bool) else complete
    some = expected.limit(1).select(F.lit(1).alias("__some"))
    gone = current.filter("is_active = 1").filter(flag).join(expected.select(key), key, "left_anti")
    if records is not None:
        unknown = expected.select(key).join(records.select(key).unionByName(current.select(key)), key, "left_anti").limit(1).select(F.lit(1).alias("__unknown"))
        gone = gone.join(F.broadcast(unknown), F.lit(True), "left_anti")
    return gone.join(F.broadcast(some), F.lit(True), "left_semi").withColumn("change_type", F.lit("WITHDRAWN"))


def snapshot_diff(live: DataFrame, snapshot: DataFrame, key: str, fields: list[str], position: str) -> DataFrame:
    """(key, field, old, new): live rows against the snapshot on the lower-cased key; snapshot rows with one key: the last.
    A row that the snapshot lacks gives the field `new`."""
    low, old = unused(live, "__key", "__old")
    last = snapshot.groupBy(F.lower(key).alias(low)).agg(F.max_by(F.struct(*fields), position).alias(old))
    j = live.withColumn(low, F.lower(key)).join(last, low, "left")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"{old}.{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new")) for f in fields]
    fresh = F.array(F.struct(F.lit("new").alias("field"), F.lit(None).cast("string").alias("old"), F.col(key).cast("string").alias("new")))
    changed = F.when(F.col(old).isNull(), fresh).otherwise(F.filter(F.array(*cells), lambda c: ~c["old"].eqNullSafe(c["new"])))
    return j.select(F.col(key), F.explode(changed).alias("c")).select(key, "c.field", "c.old", "c.new")


def merge_report(previous: DataFrame, run: DataFrame, drop: DataFrame, key: str = "filename") -> DataFrame:
    """previous without `drop`, overwritten by the run's rows; report_order() sorts and report_total() sums it."""
    gone = drop.select(key).unionByName(run.select(key)).distinct()
    return previous.join(gone, key, "left_anti").unionByName(run)


def report_total(report: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of files and the sums, nulls as 0; computed anew from the merged rows."""
    return report.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns))


def rows_hash(rows: DataFrame, columns: list[str]) -> str:
    """A hash of a table's rows as a multiset, in any order: the number of rows and two sums over their fingerprints, combined inside
    tasks. Nothing is gathered but one row."""
    f = row_fingerprint(*columns, separator="|")
    part = lambda at: F.sum(F.conv(F.substring(f, at, 15), 16, 10).cast("decimal(38,0)"))
    said = rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), part(1).cast("string"), part(16).cast("string")), 256)).first()
    return said[0]
