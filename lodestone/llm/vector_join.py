"""Near-duplicate vectors by an exact metric range join: every pair with a cosine of 0.9 or more.

Angles between vectors are a metric. A few pivots, drawn from a bounded sample and spread out over it, divide the vectors
into cells, each vector at home with its nearest pivot. By the triangle inequality a vector within the angle R of a member
of cell c is at most (its own distance from home) + 2 R, and at most (the cell's radius) + R, from c's pivot; it is copied to
every cell that this allows, as a guest. So a cell holds all partners of those at home there, and cells are joined independently:
home vectors against all members, by matrix products in double precision, whose links give counts and a spanning forest.

Equal vectors are one node with a weight. Values within 1e-9 of the threshold are worked out again by exact sums, so that the
order of summation does not decide. A cell of many home vectors is dealt in blocks of about BLOCK; a task holds one block
and reads the members batch by batch, whatever their number. A row a node, and one for each guest with a link, leave a task,
never pairs. Where vectors spread in all directions (random ones of 64 dimensions) the bounds exclude few cells: copies
come near the number of pivots, and comparisons near all pairs, as with any exact metric partition; where they cluster, cells part.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors of
different lengths do not either. Scales do not matter. Repeated vec_ids are vectors each, known by their number; without a
vec_id a vector counts, and is named in no component unless all are without. Empty tables give no rows. Only the two named
columns are read."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import durable, table
from .components import connected_components

COSINE = 0.9
#: Vectors that pivots are drawn from, pivots of one length at most, vectors a pivot where that allows, home vectors of a block.
SAMPLE, MOST_PIVOTS, CELL, BLOCK = 1024, 64, 4096, 4096
_SLACK = 1e-6


def packed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, node, v): the components as bytes of floats or doubles, and their digest; both null for what links with nothing."""
    kind = rows.schema[vector].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        rows = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    own = np.float32 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes: list[bytes | None] = []
            found: list[bytes | None] = []
            lists = b.column(1)
            values = lists.values
            gaps = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
            flat, at = values.fill_null(0).to_numpy(zero_copy_only=False).astype(own) + own(0), lists.offsets.to_numpy()
            for there, lo, hi in zip(lists.is_valid().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = flat[lo:hi]
                good = there and x.any() and np.isfinite(x).all() and not (gaps is not None and gaps[lo:hi].any())
                found.append(x.tobytes() if good else None)
                nodes.append(xxhash.xxh3_128_digest(found[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], names=["vec_id", "node", "v"])

    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return plain.mapInArrow(run, "vec_id long, node binary, v binary")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digits, so that no square passes the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def units(found: list[bytes], width: int) -> np.ndarray:
    """Vectors of one length (width bytes a component) as rows of length 1."""
    x = np.frombuffer(b"".join(found), np.float32 if width == 4 else np.float64).reshape(len(found), -1).astype(np.float64)
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(a: bytes, b: bytes, width: int, cosine: float = COSINE) -> bool:
    """The cosine of two vectors, by exact sums, against the threshold."""
    x, y = (scaled(np.frombuffer(v, np.float32 if width == 4 else np.float64).astype(np.float64)) for v in (a, b))
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist())) >= cosine


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """k of the rows: each the farthest from those before it."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def homes(nodes: DataFrame, pivots: dict[int, np.ndarray], width: int) -> DataFrame:
    """Adds len (components), cell (0 where a length has no pivots) and angle (to the cell's pivot) to (node, n_copies, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(2).to_pylist()
            size = np.array([len(v) // width for v in found], np.int32)
            cell, angle = np.zeros(len(found), np.int32), np.zeros(len(found))
            for n in np.unique(size).tolist():
                if n in pivots:
                    at = np.flatnonzero(size == n)
                    a = angles(units([found[i] for i in at], width), pivots[n])
                    cell[at], angle[at] = a.argmin(axis=1), a.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(cell), pa.array(angle)], names=["node", "n_copies", "v", "len", "cell", "angle"])

    return nodes.select("node", "n_copies", "v").mapInArrow(run, "node binary, n_copies long, v binary, len int, cell int, angle double")


def members(housed: DataFrame, pivots: dict[int, np.ndarray], cells: dict[int, dict[int, tuple[int, float]]], width: int, reach: float) -> DataFrame:
    """(len, cell, block, guest, node, n_copies, v): a vector in its own block, guest 0, and as a guest in half of the other blocks
    whose members may be within the angle `reach`; theirs come to it from the rest. cells: by length and cell the number of
    blocks and the radius."""
    schema = pa.schema([("len", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), ("guest", pa.int32()), ("node", pa.binary()), ("n_copies", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                found, home = b.column(2).to_pylist(), b.column(4).to_numpy()
                size, angle, first = b.column(3).to_numpy(), b.column(5).to_numpy(), [int.from_bytes(x[:8]) for x in b.column(0).to_pylist()]
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    a = angles(units([found[i] for i in at], width), pivots[n]) if n in pivots else np.zeros((len(at), 1))
                    begin = dict(zip(cells[n], np.cumsum([0, *(blocks for blocks, _ in cells[n].values())]).tolist(), strict=False))
                    every = sum(blocks for blocks, _ in cells[n].values())
                    own = np.array([begin[home[i]] + first[i] % cells[n][home[i]][0] for i in at.tolist()])
                    for c, (blocks, radius) in cells[n].items():
                        near = (a[:, c] <= np.minimum(angle[at] + 2 * reach, radius + reach) + _SLACK) | (home[at] == c)
                        for k in range(blocks):
                            step = (begin[c] + k - own) % every
                            rows = np.flatnonzero(near & ((2 * step < every) | ((2 * step == every) & (own < begin[c] + k))))
                            if len(rows):
                                part, guest = b.take(pa.array(at[rows])), step[rows] > 0
                                same = [pa.array(np.full(len(rows), v, np.int32)) for v in (n, c, k)]
                                yield pa.RecordBatch.from_arrays([*same, pa.array(guest.astype(np.int32)), part.column(0), part.column(1), part.column(2)], schema=schema)

    return housed.select("node", "n_copies", "v", "len", "cell", "angle").mapInArrow(run, "len int, cell int, block int, guest int, node binary, n_copies long, v binary")


class Block:
    """The home vectors of a block, what they link with, and which of them belong together."""

    def __init__(self, parts: list[pa.RecordBatch], width: int, cosine: float):
        self.width, self.cosine = width, cosine
        self.nodes = [x for p in parts for x in p.column(4).to_pylist()]
        self.raw = [x for p in parts for x in p.column(6).to_pylist()]
        self.weights = np.concatenate([p.column(5).to_numpy() for p in parts])
        self.x, self.links, self.label = units(self.raw, width), np.zeros(len(self.raw), np.int64), np.arange(len(self.raw))
        self.rough = self.x.astype(np.float32)
        # what rounding to single precision may take from a product of unit vectors
        self.margin = (self.x.shape[1] + 4) * 1.2e-7
        self.guests_found: list[tuple[bytes, bytes, int]] = []
        for k in range(0, len(self.raw), 1024):
            self._meet(self.x[k : k + 1024], self.raw[k : k + 1024], self.weights[k : k + 1024], k)

    def guests(self, part: pa.RecordBatch) -> None:
        for k in range(0, part.num_rows, 1024):
            p = part.slice(k, 1024)
            raw = p.column(6).to_pylist()
            found = self._meet(units(raw, self.width), raw, p.column(5).to_numpy(), -1)
            if found:
                nodes = p.column(4).to_pylist()
                self.guests_found += [(nodes[j], self.nodes[i], n) for j, i, n in found]

    def _meet(self, y: np.ndarray, raw: list[bytes], weights: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
        """offset: where the others are home vectors, the place of their first. Gives for a guest with links one of the home
        vectors and the weight of all."""
        near = self.rough @ y.astype(np.float32).T >= self.cosine - self.margin
        cols = np.flatnonzero(near.any(axis=0))
        if not len(cols):
            return []
        rows = np.flatnonzero(near[:, cols].any(axis=1))
        c = self.x[rows] @ y[cols].T
        hit = c >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(c - self.cosine) < 1e-9), strict=True):
            hit[i, j] = linked(self.raw[rows[i]], raw[cols[j]], self.width, self.cosine)
        if offset >= 0:
            hit &= rows[:, None] != offset + cols[None, :]
        found = []
        for k in np.flatnonzero(hit.any(axis=0)).tolist():
            j, who = int(cols[k]), rows[hit[:, k]]
            self.links[who] += weights[j]
            if offset >= 0:
                who = np.append(who, offset + j)
            else:
                found.append((j, int(who[0]), int(self.weights[who].sum())))
            labels = self.label[who]
            low = labels.min()
            if labels.max() != low:
                for r in np.unique(labels).tolist():
                    if r != low:
                        self.label[self.label == r] = low
        return found

    def rows(self) -> Iterator[tuple[bytes, bytes, int]]:
        yield from zip(self.nodes, (self.nodes[k] for k in self.label.tolist()), self.links.tolist(), strict=True)
        yield from self.guests_found


def joined(dealt: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, b, links) of each block of members(): for a home vector, and for a guest with links, the weight of those here and
    a home vector of its component."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def out(block: Block) -> Iterator[pa.RecordBatch]:
        rows = list(block.rows())
        for k in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 8192], strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, block = None, [], None
        for b in batches:
            marks = np.stack([b.column(k).to_numpy() for k in range(4)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                now, guest, part = tuple(marks[:3, lo].tolist()), marks[3, lo], b.slice(lo, hi - lo)
                if now != key:
                    if home:
                        yield from out(block or Block(home, width, cosine))
                    key, home, block = now, [], None
                if not guest:
                    home.append(part)
                elif home:
                    block = block or Block(home, width, cosine)
                    block.guests(part)
        if home:
            yield from out(block or Block(home, width, cosine))

    sorted_ = dealt.repartition("len", "cell", "block").sortWithinPartitions("len", "cell", "block", "guest")
    return sorted_.mapInArrow(run, "a binary, b binary, links long")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, most_pivots: int = MOST_PIVOTS, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """A row a vector: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept."""
    kind = rows.schema[vector].dataType
    width = 4 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else 8
    reach = math.acos(cosine)
    marked = durable(packed(rows, vec_id, vector))
    nodes = durable(marked.filter("node is not null").groupBy("node").agg(F.count("*").alias("n_copies"), F.min("vec_id").alias("least"), F.first("v").alias("v")))
    sample = defaultdict(list)
    for r in nodes.orderBy("node").limit(SAMPLE).select("v").collect():  # by digest, which is to say at random
        sample[len(r.v) // width].append(bytes(r.v))
    wanted = min(most_pivots, -(-nodes.count() // cell))
    pivots = {n: spread_out(units(v, width), wanted) for n, v in sample.items()}
    housed = durable(homes(nodes, pivots, width))
    cells: dict[int, dict[int, tuple[int, float]]] = defaultdict(dict)
    for r in housed.groupBy("len", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():
        cells[r["len"]][r["cell"]] = (-(-r["n"] // block), r["radius"])
    found = durable(joined(members(housed, pivots, dict(cells), width, reach), width, cosine))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("a <> b").select("a", "b"))
    told = nodes.select("node", "n_copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written out, so that the join has a plain exchange on either side, which adaptive execution splits at a large component
    least = durable(told.groupBy("root").agg(F.min("least").alias("component_id")))
    told = durable(told.join(least, "root").select("node", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n_copies") - 1).alias("n_links"), "component_id"))
    out = marked.select("vec_id", "node").join(told, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, and a walk along the links; right on tables of a size where that can be done.
SQL = {
    "op12_vector_join": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, MIN(root) AS component_id FROM r GROUP BY node),
d AS (SELECT a, COUNT(*) AS n FROM p GROUP BY a)
SELECT vec_id, COALESCE(d.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept FROM v JOIN c ON c.node = vec_id LEFT JOIN d ON d.a = vec_id"""
}
QUERIES = {"op12_vector_join": op12_vector_join}
