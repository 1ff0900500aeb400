"""Citation graph: resolving, ranking and walking edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.names import unused
from .retrieval import ranked

#: Orders of roles and confidences.
ROLE_ORDER = ["product specification", "test method", "sampling", "terminology", "safety", "installation", "normative reference", "general convention"]
CONFIDENCE_ORDER = ["low", "medium", "high"]


def role_rank(role: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), role)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(99)).otherwise(at - 1)


def confidence_rank(level: Column) -> Column:
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE_ORDER)), level), F.lit(0)) - 1, F.lit(0))


def resolve(edges: DataFrame, held: DataFrame) -> DataFrame:
    """edges: (..., to_number, to_part, to_section, cited_year); held: (standard_id, number, part, section, year, position).
    Left join on the three parts of the key, null as empty; of held rows with one key the last is taken. Adds in_corpus,
    resolved_id and edition_note. The held side is reduced to one row a key before the join."""
    own = unused(edges, "__number", "__part", "__section", "__held")
    key = lambda *cs: [F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in zip(own, cs, strict=False)]
    last = held.select(*key("number", "part", "section"), "standard_id", F.col("year").alias("held_year"), "position").groupBy(*own[:3]).agg(F.max_by(F.struct("standard_id", "held_year"), "position").alias(own[3]))
    out = edges.select("*", *key("to_number", "to_part", "to_section")).join(last, own[:3], "left")
    note = F.when(F.col("cited_year") != F.col(f"{own[3]}.held_year"), F.concat(F.lit("cites "), F.col("cited_year"), F.lit(", holds "), F.col(f"{own[3]}.held_year")))
    return out.select(*edges.columns, F.col(own[3]).isNotNull().alias("in_corpus"), F.col(f"{own[3]}.standard_id").alias("resolved_id"), note.alias("edition_note"))


def outgoing(edges: DataFrame, least: str = "medium", limit: int | None = None, source: str = "src", tie: str = "edge_no") -> DataFrame:
    """Each node's citations from a confidence on, by role, then confidence, then their own order."""
    floor = CONFIDENCE_ORDER.index(least)
    kept = edges.filter(confidence_rank(F.col("confidence")) >= floor)
    return ranked(kept, [source], [F.asc(role_rank(F.col("role"))), F.desc(confidence_rank(F.col("confidence"))), F.asc(tie)], limit)


def chain(roots: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 6) -> DataFrame:
    """The citations that a depth-first walk from each root meets, in its order: (root, place, depth, src, edge_rank, label, target,
    expanded). edges: (src, edge_rank, label, target), ranked for each node; target is null where the cited one is not held.

    A node's first `limit` citations are all listed; one is walked on from where it is held, the depth is not used up, and the walk has
    not expanded it before (one set of visited nodes a root). The walk is sequential, so each root's neighbourhood is gathered first,
    by a join of distinct nodes a level (at most 1 + limit + ... + limit ** (depth - 1) of them), and walked in the task that sorts it."""
    kept = edges.filter(F.col("edge_rank") <= limit).select("src", F.col("edge_rank").cast("long").alias("edge_rank"), F.col("label").cast("string").alias("label"), "target")
    level = roots.select("root", F.col("root").alias("node")).distinct()
    nodes = level
    for _ in range(depth - 1):
        level = level.join(kept.filter("target is not null"), level["node"] == kept["src"]).select("root", F.col("target").alias("node")).distinct()
        nodes = nodes.unionByName(level)
    near = nodes.distinct().join(kept, F.col("node") == kept["src"]).select("root", "src", "edge_rank", "label", "target")
    kind = dict(near.dtypes)["root"]
    schema = f"root {kind}, place long, depth int, src {kind}, edge_rank long, label string, target {kind}, expanded boolean"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def walk(root, out: dict) -> list[tuple]:
        rows: list[tuple] = []
        seen = {root}
        stack = [(1, root, e) for e in reversed(out.get(root, []))]
        while stack:
            d, src, (rank, label, target) = stack.pop()
            on = target is not None and target not in seen and d < depth
            rows.append((root, len(rows), d, src, rank, label, target, on))
            if on:
                seen.add(target)
                stack += [(d + 1, target, e) for e in reversed(out.get(target, []))]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, {}
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], schema=fields)
            done.clear()
            return got

        for b in batches:
            for root, src, rank, label, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if root != last:
                    done += walk(last, out) if out else []
                    last, out = root, {}
                    if len(done) > 10_000:
                        yield flush()
                out.setdefault(src, []).append((rank, label, target))
        done += walk(last, out) if out else []
        if done:
            yield flush()

    return near.repartition("root").sortWithinPartitions("root", "src", "edge_rank").mapInArrow(run, schema)


def unparsed(edges: DataFrame, held: DataFrame) -> DataFrame:
    """(label, citations): cited labels that no held standard has, with how often they are cited; the most cited first by label."""
    missing = edges.filter("label is not null").join(held.select(F.col("standard_id").alias("label")), "label", "left_anti")
    return missing.groupBy("label").agg(F.count("*").alias("citations"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_if("in_corpus").alias("resolved"), F.count_if(F.col("edition_note").isNotNull()).alias("outdated"))
