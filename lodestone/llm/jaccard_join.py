"""N-gram Jaccard join with Bayesian candidate pruning: all pairs of texts whose sets of five-word shingles have a
similarity of 0.8 or more.

Words are runs of word characters, lower-cased; a text of fewer than five words is one shingle. The steps:

1. Texts with the same set of shingles are one node (a 128-bit digest), so copies are never paired.
2. Each node has ROWS * BANDS MinHash values. Nodes that share a band (ROWS values) meet in a bucket. At a
   similarity of exactly 0.8 two texts share none of the bands with a probability of 3e-6.
3. In a bucket, the values' low bytes are compared a chunk at a time. A pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold (uniform prior, chance matches of the bytes counted) falls
   below TOLERANCE. A bucket yields no pairs but a spanning forest of what survives, grown seed by seed, so that a
   bucket of near copies takes about one comparison for each member.
4. The forests' connected components are families. In a family every pair is verified exactly on the whole shingle
   sets (counts from postings in numpy); what leaves the task is one row a node: its links and its component.

Buckets and families over a limit are dealt as pairs of blocks to different tasks, so that each task is bounded in rows
(MOST_ROWS) and bytes, and no pair is lost. A row is copied once for each block: MOST_BLOCKS times, or once for every 32,000
rows of its bucket or family where that is more. In a family, sets that share the same shingles with others are counted as one, so
that near copies cost about their number, not its square. Only the texts of families are shuffled: a Bloom filter of their keys (of a size
checked before; without it all texts are) keeps the others where they are.

Edge cases: a null text is empty. Texts without words have no shingles: equal ones (the empty and null ones, say) are
copies of each other, and nothing else is similar to them. A null doc_id is replaced by a hash of its text in class_id.
Repeated rows are copies, as are equal texts under one doc_id; different texts under one doc_id are documents of their
own. Ties go to the least (doc_id, hash of the text). Empty tables give no rows. Very long texts are compared whole, by
all their shingles. Only the two named columns are read; one_of_each_class gives all columns of docs back as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import durable, map_batches, own_columns, table, texts_of
from .components import connected_components

SHINGLE = 5
THRESHOLD = (4, 5)
BANDS, ROWS = 24, 4
CHUNK = 16
TOLERANCE = 1e-7
#: Rows of a bucket or family that one task takes; blocks of a larger one, up to which blocks have half as many rows; rows of
#: two blocks at most, whatever their number; shingle bytes of a block.
BUCKET_LIMIT, FAMILY_LIMIT, MOST_BLOCKS, MOST_ROWS, BLOCK_BYTES = 20_000, 4_000, 64, 64_000, 16 << 20

_WORDS = re.compile(r"\w+")
_ODD = (np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; empty where it has no word."""
    words = _WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(" ".join(words))], np.uint64)
    known = {w: digest(w) for w in set(words)}
    h = np.array([known[w] for w in words], np.uint64)
    m = len(h) - SHINGLE + 1
    out = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def node_of(text: str, found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes() if len(found) else b"\0" + text.encode("utf-8", "surrogatepass"))


def minhashes(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of 32 bits."""
    out = np.full(len(_ODD), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(found), 4096):
        np.minimum(out, ((found[k : k + 4096, None] * _ODD) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def keys_of(doc_id: str, text: str, prefix: str = "") -> list[Column]:
    """row_key and text_key of a row: its doc_id (without one, the hash of its text), and the hash of its text."""
    h = F.xxhash64(_text(text))
    return [F.coalesce(F.col(doc_id).cast("long"), h).alias(f"{prefix}row_key"), h.alias(f"{prefix}text_key")]


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, text_key, node, size (shingles), bands (one key a band, the band's number hashed in; none for a text
    without words), sketch."""

    def make():
        def f(b: pa.RecordBatch) -> dict:
            nodes, bands, marks, sizes = [], [], [], []
            for t in texts_of(b):
                found = shingles(t)
                nodes.append(node_of(t, found))
                sizes.append(len(found))
                if len(found):
                    m = minhashes(found)
                    bands.append([xxhash.xxh64_intdigest(m[ROWS * k : ROWS * (k + 1)].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)])
                    marks.append(m.astype(np.uint8).tobytes())
                else:
                    bands.append([])
                    marks.append(b"")
            return {"doc_id": b.column("doc_id"), "row_key": b.column("row_key"), "text_key": b.column("text_key"), "node": nodes, "size": sizes, "bands": bands, "sketch": marks}

        return f

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keys_of(doc_id, text), _text(text).alias("text"))
    return map_batches(rows, make, "doc_id long, row_key long, text_key long, node binary, size long, bands array<long>, sketch binary")


def least_matches(n: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """The fewest of n matching bytes with which the posterior of reaching the threshold is not below the tolerance."""
    p = threshold + (1 - threshold) / 256
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


_LEAST = [(n, least_matches(n)) for n in range(CHUNK, BANDS * ROWS + 1, CHUNK)]


def forest(marks: np.ndarray) -> list[tuple[int, int]]:
    """Edges (seed, member) that span the components of the pairs whose comparison is never given up. A row is compared with all
    rows left at once, a chunk of bytes at a time, by columns that lie together; the later chunks only with those that stay."""
    names, t = np.arange(len(marks)), np.ascontiguousarray(marks.T)
    live, left, out = np.ones(len(names), bool), len(names), []

    def near(x: np.ndarray) -> np.ndarray:
        """Places of the rows left that stay beside a row with these bytes."""
        others, matches = np.flatnonzero(live), 0
        for n, least in _LEAST:
            rows, bytes_ = t[n - CHUNK : n], x[n - CHUNK : n, None]
            # where most rows are left, all are compared, which needs no copy of those left
            equal = (rows == bytes_).view(np.uint8).sum(axis=0, dtype=np.uint8)[others] if 8 * len(others) > len(names) else (rows[:, others] == bytes_).view(np.uint8).sum(axis=0, dtype=np.uint8)
            matches = matches + equal
            stay = matches >= least
            if not stay.all():
                others, matches = others[stay], matches[stay]
                if not len(others):
                    break
        return others

    first = 0
    while left > 1:
        if 2 * left < len(names):
            names, t, live, first = names[live], np.ascontiguousarray(t[:, live]), np.ones(left, bool), 0
        first += int(live[first:].argmax())
        seed, live[first], left = int(names[first]), False, left - 1
        queue = [t[:, first].copy()]
        while queue and left:
            found = near(queue.pop())
            if len(found):
                out += [(seed, x) for x in names[found].tolist()]
                queue += list(t[:, found].T.copy())
                live[found] = False
                left -= len(found)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[x].as_py() for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Adds block_a, block_b, own_block: 0 for rows of keys without a row in `blocks` (key, blocks). The others are dealt to
    their key's blocks by a hash of the node; a row goes to every pair of blocks that its own belongs to."""
    big = durable(blocks.filter("blocks > 1"))
    if big.isEmpty():
        return rows.select("*", F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), F.lit(0).alias("own_block"))
    n = F.coalesce("blocks", F.lit(1))
    dealt = rows.join(big, key, "left").withColumn("own_block", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select(*rows.columns, F.least("own_block", "other").alias("block_a"), F.greatest("own_block", "other").alias("block_b"), "own_block")


def _blocks(n: Column, limit: int) -> Column:
    """Into how many blocks n rows are dealt: of half the limit each, but no more than MOST_BLOCKS unless two blocks would pass MOST_ROWS."""
    return F.greatest(F.least(F.ceil(n * 2 / limit), F.lit(MOST_BLOCKS)), F.ceil(n * 2 / MOST_ROWS))


def candidate_families(nodes: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(node, root) of the nodes that any pruned comparison has left with a partner. nodes: (node, bands, sketch)."""
    keys = nodes.select("node", F.explode("bands").alias("band"))
    # most bands are a node's own: only those that two nodes share get the sketches
    counts = durable(keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = keys.join(counts.select("band"), "band").join(nodes.select("node", "sketch"), "node").select("node", "sketch", "band")
    rows = in_blocks(rows, "band", counts.select("band", F.when(F.col("n") > bucket_limit, _blocks(F.col("n"), bucket_limit)).otherwise(1).cast("int").alias("blocks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []
        for g in _groups(batches, ["band", "block_a", "block_b"]):
            if g.num_rows > 1:
                found, marks = g.column("node").to_pylist(), np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(g.num_rows, -1)
                for x, y in forest(marks):
                    a.append(found[x])
                    b.append(found[y])
            if len(a) >= 4096:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    dealt = rows.repartition("band", "block_a", "block_b").sortWithinPartitions("band", "block_a", "block_b", "node")
    return connected_components(dealt.mapInArrow(run, "a binary, b binary"))


def count_links(sets: list[np.ndarray], weights: np.ndarray, blocks: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set: how many of the others have the similarity, the sum of their weights, and a number of its component.
    Where a < b, only pairs across the two blocks are looked at.

    Sets of one size with the same shared shingles (those that any other set has) are alike to all others, and are counted as
    one group: near copies of a text differ in where they differ, of which there are few ways, and in shingles of their own."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    known: dict[tuple, int] = {}
    profiles: list[np.ndarray] = []
    group = np.zeros(k, np.int64)
    for i in range(k):
        own = code[at[i] : at[i + 1]]
        own = own[held[own] > 1]
        group[i] = known.setdefault((own.tobytes(), int(sizes[i]), int(blocks[i]) if a < b else 0), len(profiles))
        if group[i] == len(profiles):
            profiles.append(own)
    g = len(profiles)
    first = np.full(g, k)
    np.minimum.at(first, group, np.arange(k))
    members, heavy = np.bincount(group, minlength=g), np.bincount(group, weights, minlength=g).astype(np.int64)
    size, block = sizes[first], blocks[first]
    owner, posted = np.repeat(np.arange(g), [len(p) for p in profiles]), np.concatenate(profiles) if g else np.zeros(0, np.int64)
    order = np.argsort(posted, kind="stable")
    posted, owner = posted[order], owner[order]
    bounds = np.searchsorted(posted, np.arange(len(held) + 1))
    lengths = np.diff(bounds)
    texts, docs, itself, root = np.zeros(g, np.int64), np.zeros(g, np.int64), np.zeros(g, bool), np.arange(g)
    up, down = THRESHOLD
    for i, own in enumerate(profiles):
        if not len(own):
            continue
        n = lengths[own]
        spots = np.repeat(bounds[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[spots], minlength=g)
        hit = down * shared >= up * (size + size[i] - shared)
        if a < b:
            hit &= block != block[i]
        itself[i] = hit[i]
        j = np.flatnonzero(hit)
        if len(j):
            texts[i], docs[i] = members[j].sum(), heavy[j].sum()
            low = min(int(root[i]), int(root[j].min()))
            for r in np.unique(np.append(root[j], root[i])).tolist():
                if r != low:
                    root[root == r] = low
    least = np.full(g, k)
    np.minimum.at(least, root, first)
    mine = itself[group]
    return texts[group] - mine, docs[group] - weights * mine, np.where(texts[group] > 0, least[root[group]], np.arange(k))


def family_texts(docs: DataFrame, families: DataFrame, doc_id: str, text: str, repeated: bool = True) -> DataFrame:
    """(row_key, text_key, text): the texts of the families' nodes, one of repeated rows (where there are any)."""
    keys = ["row_key", "text_key"]
    texts = docs.select(*keys_of(doc_id, text), _text(text).alias("text"))
    near = bloom.filtered(texts, keys, families.select(*keys), "__near")
    # an inner join, as the keys are distinct: the optimizer would move a semi-join below the filter's
    found = (texts if near is None else near.filter("__near").drop("__near")).join(families.select(*keys), keys)
    return found.groupBy(*keys).agg(F.first("text").alias("text")) if repeated else found


def verified(families: DataFrame, texts: DataFrame, family_limit: int = FAMILY_LIMIT) -> DataFrame:
    """families: (node, root, row_key, text_key, n_copies, size); texts: (row_key, text_key, text), one for each. Gives (node, class,
    n_linked_texts, n_linked_docs)."""
    bytes_, n = F.sum("size") * 8, F.count("*")
    few = _blocks(n, family_limit)
    blocks = durable(families.groupBy("root").agg(F.when((n > family_limit) | (bytes_ > 2 * BLOCK_BYTES), F.greatest(few, F.ceil(bytes_ / BLOCK_BYTES))).otherwise(1).cast("int").alias("blocks")).filter("blocks > 1"))
    rows = in_blocks(families.join(texts, ["row_key", "text_key"]), "root", blocks)
    out = pa.schema([("node", pa.binary()), ("class", pa.binary()), ("n_linked_texts", pa.int64()), ("n_linked_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for g in _groups(batches, ["root", "block_a", "block_b"]):
            a, b = g.column("block_a")[0].as_py(), g.column("block_b")[0].as_py()
            found: dict[bytes, tuple] = {}
            for node, text, n, own in zip(*(g.column(c).to_pylist() for c in ("node", "text", "n_copies", "own_block")), strict=True):
                if node not in found and node_of(text or "", s := shingles(text or "")) == node:
                    found[node] = (s, n, own)
            names = list(found)
            if names:
                t, d, r = count_links([found[x][0] for x in names], np.array([found[x][1] for x in names]), np.array([found[x][2] for x in names]), a, b)
                held += zip(names, [names[x] for x in r.tolist()], t.tolist(), d.tolist(), strict=True)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    dealt = rows.repartition("root", "block_a", "block_b").sortWithinPartitions("root", "block_a", "block_b", "node")
    found = durable(dealt.mapInArrow(run, "node binary, class binary, n_linked_texts long, n_linked_docs long"))
    if blocks.isEmpty():
        return found
    total = found.groupBy("node").agg(F.sum("n_linked_texts").alias("n_linked_texts"), F.sum("n_linked_docs").alias("n_linked_docs"))
    merged = connected_components(found.select(F.col("node").alias("a"), F.col("class").alias("b"))).withColumnRenamed("root", "class")
    return total.join(merged, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "n_linked_texts", "n_linked_docs")


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_limit: int = BUCKET_LIMIT, family_limit: int = FAMILY_LIMIT) -> DataFrame:
    """One row a document: doc_id, row_key, text_key (hashes; row_key is the doc_id where there is one), class_key (a digest; it tells classes apart where doc_ids repeat), class_id (the least row_key of its class), n_copies (documents of the same
    shingle set, itself included), n_links (other documents with the similarity, copies among them) and n_linked_texts
    (different texts among those)."""
    marked = durable(sketches(docs, doc_id, text))
    nodes = marked.groupBy("node").agg(F.min(F.struct("row_key", "text_key")).alias("k"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = durable(nodes.select("node", "k.row_key", "k.text_key", "n_copies", "size", "bands", "sketch"))
    families = candidate_families(nodes.filter(F.size("bands") > 0).select("node", "bands", "sketch"), bucket_limit).join(nodes.select("node", "row_key", "text_key", "n_copies", "size"), "node")
    families = durable(families)
    repeated = not marked.groupBy("row_key", "text_key").count().filter("count > 1").isEmpty()
    links = verified(families, family_texts(docs, families, doc_id, text, repeated), family_limit)
    told = nodes.select("node", "row_key", "n_copies").join(links, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = told.groupBy("class").agg(F.min("row_key").alias("class_id"))
    told = told.join(least, "class").select("node", F.col("class").alias("class_key"), "class_id", "n_copies", (F.coalesce("n_linked_docs", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"))
    return marked.select("doc_id", "row_key", "text_key", "node").join(told, "node").drop("node")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).drop("row_key", "text_key", "class_key")


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the least (row_key, text_key) of their class, one of repeated rows; all columns stay. Rows that
    are alone in their class stay where they are; only the others' (by a Bloom filter of their keys) are shuffled."""
    keys = ["__row_key", "__text_key"]
    rows = durable(similarity_classes(docs, doc_id, text).select("class_key", F.col("row_key").alias(keys[0]), F.col("text_key").alias(keys[1])))
    several = durable(rows.groupBy("class_key").agg(F.min(F.struct(*keys)).alias("k"), F.count("*").alias("n")).filter("n > 1"))
    shared = rows.join(several.select("class_key"), "class_key", "left_semi").select(*keys).distinct()
    shared = durable(shared.join(several.select("k.*", F.lit(True).alias("__least")), keys, "left").select(*keys, F.coalesce("__least", F.lit(False)).alias("__least")))
    every = docs.select(*own_columns(docs), *keys_of(doc_id, text, "__"))
    told = bloom.filtered(every, keys, shared, "__shared")
    others = every if told is None else told.filter("__shared").drop("__shared")
    # without a row in `shared`: alone in its class, let through by the filter
    kept = others.join(shared, keys, "left").filter(F.coalesce("__least", F.lit(True))).dropDuplicates(keys).select(*own_columns(docs))
    return kept if told is None else told.filter("not __shared").select(*own_columns(docs)).unionByName(kept)


#: By joining shingles as texts and walking the links; right on tables of a size where that can be done.
SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(lower(COALESCE(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, text, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
k AS (SELECT doc_id, sh, CASE WHEN len(sh) = 0 THEN 'text ' || text ELSE 'set ' || md5(array_to_string(list_sort(sh), '|')) END AS node FROM s),
n AS (SELECT node, MIN(doc_id) AS rep, COUNT(*) AS n_copies, any_value(sh) AS sh FROM k GROUP BY node),
x AS (SELECT rep, len(sh) AS size, unnest(sh) AS one FROM n),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.one = b.one AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.size, b.size HAVING 5 * COUNT(*) >= 4 * (a.size + b.size - COUNT(*))),
r AS (SELECT rep AS node, rep AS root FROM n UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, MIN(root) AS class_id FROM r GROUP BY node),
d AS (SELECT p.a AS rep, COUNT(*) AS texts, SUM(n.n_copies) AS docs FROM p JOIN n ON n.rep = p.b GROUP BY p.a)
SELECT k.doc_id, c.class_id, n.n_copies, CAST(COALESCE(docs, 0) + n.n_copies - 1 AS BIGINT) AS n_links, COALESCE(texts, 0) AS n_linked_texts
FROM k JOIN n USING (node) JOIN c ON c.node = n.rep LEFT JOIN d ON d.rep = n.rep"""
}
QUERIES = {"op10_jaccard_join": op10_jaccard_join}
