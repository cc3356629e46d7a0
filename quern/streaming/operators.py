"""Streaming operators: windows and watermarks where they suffice, keyed state where they do not.

Each has a batch twin in ``quern.operators.state`` or ``quern.operators.versions``
with the same results on the same events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quern.operators.state import apply_event
from quern.sources import upserts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State outside the heap; keyed-state operators need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def events_stream(spark, path: str, schema: T.StructType, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with its event time as a timestamp with zone, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def window_hits(events: DataFrame, key: str, ts: str, window: str, late: str = "1 day") -> DataFrame:
    """Hits per key and tumbling window (T-1); windows end for good once the watermark passes them."""
    counts = events.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("hits"))
    return counts.select(key, F.col("w.start").alias("window_start"), "hits")


def once(events: DataFrame, event_id: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each event id once (T-3, first half); state older than the watermark is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])


def session_counts(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions that slide with use (T-4)."""
    out = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("uses"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "uses")


class _DailyCap(StatefulProcessor):
    """Items a viewer has opened on a day; key: viewer and day."""

    def __init__(self, limit: int, ttl_ms: int | None):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "item string", "at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = {k[0] for k in self.seen.keys()}
        for pdf in rows:
            out = []
            for r in pdf.sort_values("seq").itertuples():
                ok = r.item in have or len(have) < self.limit
                if ok and r.item not in have:
                    have.add(r.item)
                    self.seen.updateValue((r.item,), (int(r.seq),))
                out.append((key[0], key[1], r.item, int(r.seq), ok))
            yield pd.DataFrame(out, columns=["viewer", "day", "item", "seq", "allowed"])

    def close(self) -> None:
        pass


def daily_cap(events: DataFrame, viewer: str, ts: str, item: str, seq: str, limit: int, ttl_ms: int | None = None) -> DataFrame:
    """Verdict on each view, as it comes (T-2). With ``ttl_ms``, two days say, state goes that long after its last use."""
    rows = events.select(F.col(viewer).cast("string").alias("viewer"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.col(item).cast("string").alias("item"), F.col(seq).cast("long").alias("seq"))
    return rows.groupBy("viewer", "day").transformWithStateInPandas(_DailyCap(limit, ttl_ms), "viewer string, day string, item string, seq long, allowed boolean", "append", "processingTime" if ttl_ms else "none")


class _Subscriptions(StatefulProcessor):
    """Plan state of one user: time of the last applied event and its subscription."""

    def __init__(self, plans: dict[str, str]):
        self.plans = plans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("plan", "at long, sub string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, sub = self.state.get() if self.state.exists() else (None, None)
        state = {"at": at, "sub": sub}
        for pdf in rows:
            out = []
            for r in pdf.sort_values("arrival").itertuples():
                outcome, plan, _ = apply_event(state, int(r.occurred_at), r.subscription, r.status, r.price, r.quantity, self.plans)
                out.append((key[0], r.event_id, outcome, plan))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "plan"])
        if state["at"] is not None:
            self.state.update((state["at"], state["sub"]))

    def close(self) -> None:
        pass


def subscription_outcomes(events: DataFrame, plans: dict[str, str]) -> DataFrame:
    """Outcome of each subscription event, late ones found by event time (T-3). Duplicates go first, see :func:`once`."""
    rows = events.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("event_id"), F.col("arrival").cast("long").alias("arrival"), F.col("occurred_at").cast("long").alias("occurred_at"), "subscription", "status", "price", F.col("quantity").cast("int").alias("quantity"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Subscriptions(plans), "user_id string, event_id string, outcome string, plan string", "append", "none")


def upsert_latest(events: DataFrame, keys: list[str], at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key in a table (T-13, U7), batch by batch; :func:`upserts.read` reads it.

    A batch writes to the buckets it touches. Its number is committed with its
    rows, so a batch that runs again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        upserts.upsert(path, batch, keys, at, number)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything available, into a table in memory: for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def append_log(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON lines, appended as they come."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_version(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls a batch operator, such as a version diff, for each batch (T-11)."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
