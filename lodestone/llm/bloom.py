"""Bloom filters as tables of words: built by aggregation, tested inside rows by integer operations, no Python.

A filter too large for a literal is dealt to shards by a hash of the key, one row (shard, words) each of SHARD_BYTES.
Rows meet their shard's words by a join on the shard's number: a broadcast one where the whole filter, whose size is
computed from a count before anything is built, is at most MOST_BROADCAST, else a shuffled one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_BYTES, MOST_BROADCAST = 64 << 10, 256 << 20


def positions(keys: list[Column], seed: int, bits: int, hashes: int) -> list[Column]:
    h1, h2 = F.xxhash64(*keys, F.lit(2 * seed)), F.xxhash64(*keys, F.lit(2 * seed + 1))
    return [F.pmod(F.shiftrightunsigned(h1, 2) + F.shiftrightunsigned(h2, 8) * i, F.lit(bits).cast("long")) for i in range(hashes)]


def passes(words: Column, keys: list[Column], seed: int, bits: int, hashes: int) -> Column:
    """Whether all bits of the key are set in an array of 64-bit words."""
    ok = F.lit(True)
    for p in positions(keys, seed, bits, hashes):
        ok = ok & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return ok


def shard_of(keys: list[Column], shards: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(-1)), F.lit(shards)).cast("int")


def words_by_shard(rows: DataFrame, keys: list[str], shard: str, shards: int, seed: int, bits: int, hashes: int) -> DataFrame:
    """(shard, words): for every shard an array of bits / 64 words. Bits are joined inside tasks before the exchange."""
    n = bits // 64
    spots = rows.select(F.col(shard).alias("shard"), F.explode(F.array(*positions([F.col(k) for k in keys], seed, bits, hashes))).alias("p"))
    spots = spots.select("shard", F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    none = rows.sparkSession.range(shards * n).select(F.floor(F.col("id") / n).cast("int").alias("shard"), (F.col("id") % n).alias("w"), F.lit(0).cast("long").alias("b"))
    found = spots.unionByName(none).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
    return found.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def meeting(table: DataFrame, bytes_: int) -> DataFrame:
    """A table of shards, marked for a broadcast where its size allows."""
    return F.broadcast(table) if bytes_ <= MOST_BROADCAST else table


def filtered(rows: DataFrame, keys: list[str], wanted: DataFrame, name: str) -> DataFrame | None:
    """rows with a boolean `name`: true where the keys are among `wanted` (each key once), and for about one other row in
    two hundred. None where the filter would be larger than MOST_BROADCAST: the caller then goes on without."""
    n, each, hashes = wanted.count(), 12, 8
    shards = max(1, -(-n * each // (8 * SHARD_BYTES)))
    bits = max(64, -(-n * each // shards // 64) * 64)
    if shards * bits // 8 > MOST_BROADCAST:
        return None
    cols = [F.col(k) for k in keys]
    words = words_by_shard(wanted.withColumn("__shard", shard_of(cols, shards)), keys, "__shard", shards, 0, bits, hashes).withColumnsRenamed({"shard": "__shard", "words": "__words"})
    met = rows.withColumn("__shard", shard_of(cols, shards)).join(F.broadcast(words), "__shard")
    return met.withColumn(name, passes(F.col("__words"), cols, 0, bits, hashes)).drop("__shard", "__words")
