"""Connected components of an edge table, by alternating large-star and small-star steps; nothing reaches the driver
but one row of counts a round. The number of rounds grows with the logarithm of the largest component's diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) with u > v, each once."""
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one orderable type; loops and repeated edges do no harm. Gives (node, root) for every node that
    has an edge to another; root is the least node of its component, and is itself among the nodes."""
    e = durable(_pairs(edges, "a", "b"))
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # written out, so that the join below has a plain exchange on either side, which adaptive execution splits where a
        # node is the hub of many edges
        least = durable(both.groupBy("x").agg(F.min("y").alias("m")))
        large = _pairs(both.join(least, "x").filter("y > x").select("y", F.least("x", "m").alias("m")), "y", "m")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = durable(_pairs(small.select(F.col("v").alias("y"), "m").unionAll(small.select(F.col("u").alias("y"), "m")), "y", "m"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
