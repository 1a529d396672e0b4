"""Keyed streaming state: URLs seen once, and polite fetch times per host.

Both keep their state in the state store by key, so a batch reads and writes the
keys of its own rows only, whatever came before; the state is checkpointed with the
query and moves to another executor when one is lost.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Processors travel by value: Spark also loads them in a Python process beside the driver, which has no shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep keyed state in RocksDB (a started query keeps its own copy of the settings); the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


class _First(StatefulProcessor):
    """Of each key's rows the least by the given columns, and only if the key is new."""

    def __init__(self, order: list[str], revisit_ms: int | None):
        self.order, self.revisit_ms = order, revisit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("seen", LongType())])
        self.seen = handle.getValueState("seen", schema, self.revisit_ms) if self.revisit_ms else handle.getValueState("seen", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((1,))
        yield min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((1,))

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: str, order: list[str], seen: DataFrame | None = None, revisit_ms: int | None = None) -> DataFrame:
    """Of a stream, each key's first row: in the batch that brings the key, its least row by the order (nulls first).

    seen: a table with the key column, whose keys count as seen from the start. revisit_ms: a key may come again after so long (processing time).
    """
    start = seen.select(key).distinct().groupBy(key) if seen is not None else None
    time = "processingTime" if revisit_ms else "none"
    return rows.groupBy(key).transformWithState(_First(order, revisit_ms), rows.schema, "append", time, start)


class _Polite(StatefulProcessor):
    """A queue per host: places by number in a map, so taking one costs the same however long the queue is; one timer for its head."""

    def __init__(self, default_ms: int):
        self.default_ms = default_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.queue = handle.getMapState("queue", long("n"), StructType([StructField("url", StringType()), StructField("asked", LongType()), StructField("at", LongType())]))
        self.place = handle.getValueState("place", long("head", "tail", "free"))  # queue[head:tail] waits; the host is free at `free`

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head, tail, free = self.place.get() if self.place.exists() else (0, 0, None)
        first = head == tail
        for r in sorted(rows, key=lambda r: (r.asked, r.url)):
            at = r.asked if free is None else max(r.asked, free)
            free = at + (self.default_ms if r.delay is None else r.delay)
            if first:
                self.handle.registerTimer(at)
                first = False
            self.queue.updateValue((tail,), (r.url, r.asked, at))
            tail += 1
        self.place.update((head, tail, free))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head, tail, free = self.place.get()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        while head < tail:
            url, asked, at = self.queue.getValue((head,))
            if at > now:
                self.handle.registerTimer(at)
                break
            self.queue.removeKey((head,))
            head += 1
            yield Row(host=key[0], url=url, asked=asked, fetch_at=at)
        self.place.update((head, tail, free))

    def close(self) -> None:
        pass


def polite_stream(requests: DataFrame, default_delay_ms: int = 0, late: str = "0 seconds") -> DataFrame:
    """From a stream of (host, url, requested_at, delay_ms) the rows (host, url, requested_at, fetch_at), each released when event time reaches its fetch_at.

    Requests of a host are served in order of requested_at, then url, within a batch, batch after batch; fetch_at is
    the request's time or, if later, the previous fetch plus the delay that request named (null: the default).
    A host's queue is its own state: a busy host delays no other.
    """
    timed = requests.withWatermark("requested_at", late).select("host", "url", "requested_at", F.unix_millis("requested_at").alias("asked"), F.col("delay_ms").cast("long").alias("delay"))
    out = timed.groupBy("host").transformWithState(_Polite(default_delay_ms), "host string, url string, asked long, fetch_at long", "append", "eventTime")
    return out.select("host", "url", F.timestamp_millis("asked").alias("requested_at"), F.timestamp_millis("fetch_at").alias("fetch_at"))
