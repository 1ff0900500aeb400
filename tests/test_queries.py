"""Every registered query of the base library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lodestone.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return cols, sorted(map(repr, f.where(frame[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(registry.SQL[name]).df())
    assert got == want


def test_every_query_has_rows_or_sql(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, SF).count() >= 0


def test_rate_limiter_equals_a_loop(spark):
    from collections import deque

    want = {}
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    for _, g in e.groupby("user_id"):
        seen = deque()
        for r in g.itertuples():
            at = r.ts.timestamp()
            while seen and at - seen[0] > 12 * 3600:
                seen.popleft()
            want[r.event_id] = len(seen) < 2
            if want[r.event_id]:
                seen.append(at)
    got = {r.request: r.admitted for r in registry.QUERIES["rate_limiter"](spark, SF).collect()}
    assert got == want
