"""The vector join against all pairs."""

import math

import numpy as np
import pytest

from lodestone.llm import vector_join as V


def brute(rows):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    good = {i: x / np.abs(x).max() for i, x in good.items()}
    links = {i: {j for j, y in good.items() if j != i and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9} for i, x in good.items()}
    out = {}
    for i, _ in rows:
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += links.get(k, ())
        out[i] = (len(links.get(i, ())), min(seen), i == min(seen))
    return out


def some_vectors(dims, groups, each, seed, kind):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = r.normal(size=dims)
        for _ in range(each):
            rows.append((base + r.normal(size=dims) * r.choice([0.0, 0.15, 0.4])) * r.choice([1.0, 3.0, 1e-20 if kind == "float" else 1e-200]))
    rows = [v.astype(np.float32 if kind == "float" else np.float64).tolist() for v in rows]
    rows += [None, [], [0.0] * dims, [math.nan] + [1.0] * (dims - 1), [math.inf] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0] * (dims + 1), [2.0] * (dims + 1), *[rows[0]] * 5]
    order = r.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("dims, kind, limits", [(8, "float", {}), (8, "double", {"cell": 16, "block": 5}), (24, "float", {"cell": 10, "block": 1000}), (3, "double", {"cell": 7, "block": 3})])
def test_join_equals_all_pairs(spark, dims, kind, limits):
    rows = some_vectors(dims, 25, 8, dims, kind)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, v string").repartition(3)
    got = V.near_vectors(df, **limits).collect()
    assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_values_at_the_threshold(spark):
    """Cosines of exactly 0.9, and of as little less as doubles tell."""
    rows = [(0, [10.0, 0.0, 0.0]), (1, [9.0, math.sqrt(19.0), 0.0]), (2, [0.0, 3.0, 4.0]), (3, [0.0, 3.0 * (1 - 1e-12), 4.0])]
    v = rows[1][1]
    exact = 90.0 / math.sqrt(100 * math.fsum(x * x for x in v)) >= 0.9
    got = {r.vec_id: r for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0].n_links == int(exact) and got[2].component_id == got[3].component_id == 2


def test_chain_of_links_is_one_component(spark):
    turn = math.acos(0.9) * 0.9
    rows = [(100 - k, [math.cos(turn * k), math.sin(turn * k), 0.5]) for k in range(10)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), cell=2, block=2).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_repeated_and_missing_numbers_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.1]), (None, None)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in V.near_vectors(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", 0, "1", True), ("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    assert V.near_vectors(spark.createDataFrame([], kind)).count() == 0
