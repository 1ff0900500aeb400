"""The index of inverted lists: recall against all pairs, reuse, lists that are large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import vector_index as V

SF = "/root/testdata/sf0.01"


def vectors(spark, n, dims, clusters, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(clusters, dims))[r.integers(0, clusters, n)] + r.normal(size=(n, dims)) * (0.3 if clusters > 1 else 1.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(n, None)], "vec_id long, embedding array<float>").repartition(3)


def recall(found, exact):
    pairs = lambda df: {(r.query, r.vec_id) for r in df.collect()}
    a, b = pairs(found), pairs(exact)
    return len(a & b) / len(b)


@pytest.mark.parametrize("dims, clusters, share", [(16, 40, 0.4), (32, 1, 1.0)])
def test_recall(spark, tmp_path, dims, clusters, share):
    v = vectors(spark, 3000, dims, clusters)
    index = V.VectorIndex(spark, str(tmp_path / "ix")).refresh(v, "f")
    entry = index.log.latest()[1]
    assert entry["probes"] <= share * len(entry["centroids"]) and sum(entry["counts"].values()) == 3000
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found, exact = index.search(q, 20), R.knn(q, v.select("vec_id", F.col("embedding").alias("v")), 20)
    assert recall(found, exact) >= 0.9 and found.groupBy("query").count().filter("count = 20").count() == 60
    # all lists, in blocks of any size: the exact rows
    every = index.search(q, 20, probes=10_000, block=17, query_block=13)
    key = lambda df: sorted((r.query, r["rank"], r.vec_id) for r in df.collect())
    assert key(every) == key(exact)


def test_a_second_call_reads_the_lists_it_asks(spark, tmp_path):
    v = vectors(spark, 400, 8, 6)
    V.VectorIndex(spark, str(tmp_path / "ix")).refresh(v, "f")
    again = V.VectorIndex(spark, str(tmp_path / "ix")).refresh(v, "f")
    assert again.log.latest()[0] == 1
    one = v.filter("vec_id = 5").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found = again.search(one, 3, probes=1)
    assert found.first().vec_id == 5
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "list#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert again.refresh(v.limit(10), "g").log.latest()[0] == 2 and sum(again.log.latest()[1]["counts"].values()) <= 10
    assert again.refresh(v.limit(0), "h").search(one, 3).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test data")
def test_registered_query_reaches_nine_tenths(spark):
    from lodestone.plans import registry

    assert recall(registry.QUERIES["knn_index"](spark, SF), registry.QUERIES["knn_topk"](spark, SF)) >= 0.9
