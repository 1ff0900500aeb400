"""Prefix trie of conversations: which beginnings they share, how often, and how much a shared prefix saves.

A turn is a digest of its role and text; a conversation's prefixes are chained digests, each of the one before and the next
turn's. Every prefix is exploded to a row, and the rows of one (depth, digest) are a node. For sums over subtrees every node
is exploded to its ancestors; as a node belongs to its least member, and a conversation's own nodes are a tail of its path,
their sums are first folded along that path (a running sum from its end), so that a conversation sends one row to each of
its prefixes, not one for each node and ancestor.

Scale: texts never leave the task that reads them, only digests are shuffled. Conversations are streamed turn by turn, so
one of any length needs the memory of a batch. A prefix that a third of all conversations share is counted inside tasks
before the exchange; the numbers of conversations that end in one node are dealt by range, joined to strings of bounded
length there, and only these strings meet in one task, which digests them as they come.

Edge cases: null roles and texts are empty; a null turn comes first; turns of one number go by role, then by digest; rows
without a conv_id are left out, as a sum over members has no name for them. Repeated rows are turns each. Empty texts add a
turn of 0 bytes. Empty tables give no rows, not even a root. Only the four named columns are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

# --- fixed values ---------------------------------------------------------------------------------------------
FAMILY, MOST_SHARED = 5, 9
# ----------------------------------------------------------------------------------------------------------------

ROOT = bytes(32)
NOTHING = hashlib.sha256(b"").hexdigest()
#: Bytes of joined numbers that one row carries.
CHUNK = 1 << 18


def numbered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, digest, bytes of the text)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.octet_length(name(role)).cast("string"), F.lit(":"), name(role), name(text))
    turns = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), name(role).alias("role"), F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(name(text)).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return turns.filter("conv_id is not null").withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "digest", "bytes")


def taken_over(conv_id: Column, most: int = MOST_SHARED) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % most


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """numbered_turns() of the conversations as rebuilt: the first turns are those of conversation c - c % family, the rest
    their own. (conv_id, part, pos, digest, bytes), in order of part and pos; part 0 is a row without a turn for each conversation."""
    own = turns.filter(F.col("pos") > taken_over(F.col("conv_id"), most)).withColumn("part", F.lit(2))
    ids = turns.select("conv_id").distinct()
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "head")
    near = F.explode(F.transform(F.sequence(F.lit(1 - family), F.lit(family - 1)), lambda k: F.try_add("head", k.cast("long"))))
    given = heads.select("*", near.alias("conv_id")).filter((F.col("conv_id") - F.col("conv_id") % family == F.col("head")) & (F.col("pos") <= taken_over(F.col("conv_id"), most)))
    given = given.join(ids, "conv_id", "left_semi").withColumn("part", F.lit(1))
    names = ["conv_id", "part", "pos", "digest", "bytes"]
    start = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return start.select(*names).unionByName(given.select(*names)).unionByName(own.select(*names))


def prefixes(steps: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, bytes, last): a row for each prefix of each conversation, the empty one at depth 0.
    steps: (conv_id, part, pos, digest, bytes), a row of part 0 for each conversation before its turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        depth, at = 0, ROOT
        for b in batches:
            for conv, part, digest, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if part == 0:
                    if held:
                        held[-1][5] = True
                    depth, at, before = 0, ROOT, None
                else:
                    depth, before = depth + 1, at
                    at = hashlib.sha256(before + digest).digest()
                held.append([conv, depth, at, before, n, False])
            if len(held) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held[:-1], strict=True), schema, strict=True)], schema=schema)
                held = held[-1:]
        if held:
            held[-1][5] = True
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    # by a hash of its own: dealing by conv_id is left out where the parts of a union are dealt so already, and adaptive
    # execution then joins each part's partitions differently
    dealt = steps.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "digest", "bytes")
    return dealt.mapInArrow(run, "conv_id long, depth int, digest binary, parent binary, bytes long, last boolean")


def joined_digests(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(digest, ends_sha256): the hash of the comma-joined ascending conv_ids of each digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        out: list[tuple] = []
        for b in batches:
            for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest != key or size > chunk:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, size = digest, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) > 1024 or sum(len(x[2]) for x in out) > 4 * chunk:
                yield batch(out)
                out = []
        if ids:
            out.append((key, first, ",".join(ids)))
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            out = []
            for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest == key:
                    h.update(b",")
                else:
                    if h:
                        out.append((key, h.hexdigest()))
                    key, h = digest, hashlib.sha256()
                h.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["digest", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["digest", "ends_sha256"])

    dealt = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    parts = dealt.mapInArrow(strings, "digest binary, first long, ids string")
    return parts.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(digests, "digest binary, ends_sha256 string")


def trie(steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of conversations given as for prefixes(): conv_id (the least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of turns that members repeat), ends_sha256, and digest (hex)."""
    every = durable(prefixes(steps))
    nodes = every.groupBy("digest", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"))
    nodes = durable(nodes)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(kids, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # (conv_id, depth) names a node once, and so is a key without large groups
    weights = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    folded = every.select("conv_id", "depth", "digest").join(weights, ["conv_id", "depth"], "left")
    folded = folded.select("digest", F.sum(F.coalesce("w", zero)).over(path).alias("w"), F.sum(F.coalesce("leaf", zero)).over(path).alias("leaf"))
    below = folded.groupBy("digest").agg(F.sum("w").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = joined_digests(every.filter("last"), chunk)
    up = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(up, "parent", "left").join(below, "digest").join(ends, "digest", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = durable(numbered_turns(table(spark, sf_dir, "conversations")))
    return trie(rebuilt(turns)).drop("digest")


#: The checksum of a number's digits, bit by bit, as SQL has none; a node's key is its list of turns.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) % 9"
SQL = {
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role)) || ':' || role || text)) AS l, {_CRC} AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(COALESCE(b.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d, l[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(l[d].t)) END AS bytes, d = len(l) AS last FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT d, k, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, any_value(bytes) AS bytes, COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM p GROUP BY d, k),
u AS (SELECT n.*, m.conv_id AS parent_conv_id, (SELECT COUNT(*) FROM n x WHERE x.d = n.d + 1 AND x.k[1:n.d] = n.k) AS n_children FROM n LEFT JOIN n m ON m.d = n.d - 1 AND m.k = n.k[1:n.d - 1]),
s AS (SELECT p.d, p.k, SUM((u.n_convs - 1) * u.bytes) AS saved_tokens, COUNT(*) FILTER (WHERE u.n_children = 0) AS n_leaves FROM u JOIN p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.d, p.k)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM u JOIN s USING (d, k)"""
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
