"""A stateful debounce: a batch of changes is held until nothing has come for a gap, then given out at once.

State is one open batch for each key, with the paths that changed; a timer on event time closes it. What comes
while a batch is worked on waits for the next micro-batch, where at most one batch of a key is queued: those that closed
meanwhile are merged. A restart goes on from the checkpoint with open batches and timers as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .changes import asks_rebuild, event_time

#: The state store that processors with timers need; set it on the session before the query starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CLOSED = "key string, batch long, first timestamp, last timestamp, events long, paths array<string>, rebuild boolean"
_OPEN = "batch long, first_us long, last_us long, events long, rebuild boolean"
_EPOCH = pd.Timestamp("1970-01-01")


class Debounce(StatefulProcessor):
    """Rows key, ts, path. One row of CLOSED for each batch, when the watermark has passed its last change by the gap.

    Changes of a key count in order of time within a micro-batch, and one no earlier than the gap after the last
    begins a batch. Paths of a batch are different ones, sorted; a batch's paths are its state, one entry each."""

    def __init__(self, gap_seconds: int) -> None:
        self.gap_us = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.paths = handle.getMapState("paths", "path string", "seen boolean")
        self.count = handle.getValueState("count", "n long")

    def _close(self, key: str) -> pd.DataFrame:
        batch, first, last, events, rebuild = self.open.get()
        paths = sorted(p[0] for p in self.paths.keys())
        self.paths.clear()
        self.open.clear()
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.count.update((batch + 1,))
        at = lambda us: _EPOCH + pd.Timedelta(us, "us")
        return pd.DataFrame({"key": [key], "batch": [batch], "first": [at(first)], "last": [at(last)], "events": [events], "paths": [paths], "rebuild": [rebuild]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows).sort_values("ts", kind="stable")
        for ts, path in zip(every["ts"], every["path"], strict=True):
            us = (pd.Timestamp(ts).tz_localize(None) - _EPOCH) // pd.Timedelta(1, "us")
            if self.open.exists() and us - self.open.get()[2] >= self.gap_us:
                yield self._close(key[0])
            if self.open.exists():
                batch, first, last, events, rebuild = self.open.get()
            else:
                batch, first, last, events, rebuild = (self.count.get()[0] if self.count.exists() else 0), us, us, 0, False
            self.open.update((batch, min(first, us), max(last, us), events + 1, rebuild or (path is not None and asks_rebuild(path))))
            if path is not None:
                self.paths.updateValue((path,), (True,))
        if self.open.exists():
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer((self.open.get()[2] + self.gap_us) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._close(key[0])

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, key: str, ts: str, path: str, gap_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """The closed batches of a stream of changes: key (as text), batch (from 0), first, last, events, paths, rebuild. The session
    needs STORE."""
    rows = stream.select(F.col(key).cast("string").alias("key"), event_time(F.col(ts)).alias("ts"), F.col(path).cast("string").alias("path"))
    rows = rows.where("key is not null and ts is not null").withWatermark("ts", watermark)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Debounce(gap_seconds), outputStructType=CLOSED, outputMode="append", timeMode="EventTime")


def one_queued(closed: DataFrame) -> DataFrame:
    """Closed batches of one micro-batch, those of a key merged into one: at most one is queued behind the one at work."""
    return closed.groupBy("key").agg(F.min("batch").alias("batch"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"), F.bool_or("rebuild").alias("rebuild"))  # bounded by what changed since the last micro-batch


def follow_debounced(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, key: str, ts: str, path: str, gap_seconds: int, watermark: str = "0 seconds"):
    """Runs refresh(one batch of each key, number) for what has closed; one micro-batch is worked on at a time, so what closes
    meanwhile waits, merged, for the next."""
    closed = debounced(stream, key, ts, path, gap_seconds, watermark)
    return closed.writeStream.foreachBatch(lambda df, n: refresh(one_queued(df), n)).option("checkpointLocation", checkpoint)
