"""Greedy rate limiter: a request is admitted while fewer than `limit` admitted ones are at most `window` seconds old.
Rejected requests do not count; requests without a time are rejected. As a batch over ordered rows, and as a stateful stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW = 30, 60.0
#: Seconds that a stream's clock is set ahead by, as Spark's begins at 0 and takes what is not after it for late.
AHEAD = 4_000_000_000


def admit(seen: deque, at: float | None, limit: int, window: float) -> bool:
    if at is None or at != at:
        return False
    while seen and at - seen[0] > window:
        seen.popleft()
    if len(seen) >= limit:
        return False
    seen.append(at)
    return True


def rate_limited(requests: DataFrame, client: str, at: str, request: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """(client, request, admitted). Partitions are sorted and streamed: only the admitted times of the client at hand, at
    most `limit`, are held."""
    rows = requests.select(F.col(client).cast("string").alias("client"), F.col(request).cast("long").alias("request"), F.col(at).cast("timestamp").cast("double").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), deque()
        for b in batches:
            out = []
            for c, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != last:
                    last, seen = c, deque()
                out.append(admit(seen, t, limit, window))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=["client", "request", "admitted"])

    return rows.repartition("client").sortWithinPartitions("client", "at", "request").mapInArrow(run, "client string, request long, admitted boolean")


def rate_limited_stream(requests: DataFrame, client: str, at: str, request: str, limit: int = LIMIT, window: float = WINDOW, lateness: float = WINDOW) -> DataFrame:
    """The same as a stateful streaming operator. A client's state is its admitted times, at most `limit`; it is removed once the stream's
    clock (the latest time seen, less `lateness` seconds) has passed the last of them by the window, so that clients who went away leave nothing.
    A request older than the clock when its micro-batch begins gets no answer: state that would decide on it may be gone. Of a
    client's requests in a batch only times and numbers are gathered, to be put in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = requests.select(F.col(client).cast("string").alias("client"), F.col(request).cast("long").alias("request"), F.col(at).cast("timestamp").alias("at"))
    # without a time there is nothing to wait for
    timed = rows.withColumn("seconds", F.col("at").cast("double")).withColumn("at", F.timestamp_seconds(F.col("seconds") + AHEAD)).withWatermark("at", f"{max(0, int(lateness * 1000))} milliseconds")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = deque(state.get[0] if state.exists else [])
        parts = [(f["seconds"].to_numpy(np.float64, na_value=np.nan), f["request"].to_numpy()) for f in frames]
        seconds, number = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((number, seconds))
        admitted = [admit(seen, t, limit, window) for t in seconds[order].tolist()]
        if seen:
            state.update((list(seen),))
            # a state may not be set to expire before the clock
            state.setTimeoutTimestamp(max(int((seen[-1] + window + AHEAD) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        for k in range(0, len(order), 10_000):
            yield pd.DataFrame({"client": key[0], "request": number[order[k : k + 10_000]], "admitted": admitted[k : k + 10_000]})

    return timed.groupBy("client").applyInPandasWithState(run, "client string, request long, admitted boolean", "seen array<double>", "append", GroupStateTimeout.EventTimeTimeout)
