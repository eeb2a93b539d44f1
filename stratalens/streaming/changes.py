"""Change feeds.

A batch is closed by a gap since the last change (never restarted by polls that saw none); repeats in a
batch are dropped, and no event is. Watermarks need TIMESTAMP, so zone-less times are cast first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes that a watcher ignores, and files whose change calls for a full build.
WATCH_IGNORED = [".git/", ".pixi/", "build/", "dist/", "node_modules/"]
REBUILD = ["package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "pixi.toml", "pixi.lock", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "pyproject.toml", "poetry.lock", "uv.lock", "requirements.txt", "requirements-dev.txt", "requirements-dev.lock", ".gitignore"]
REBUILD_NAMES = r"(?:^|/)(?:tsconfig\.json|jsconfig\.json|tsconfig\..+\.json)$"


def watched(path: Column) -> Column:
    out = F.lit(True)
    for p in WATCH_IGNORED:
        out = out & ~F.startswith(path, F.lit(p))
    return out


def needs_rebuild(path: Column) -> Column:
    return path.isin(REBUILD) | path.rlike(REBUILD_NAMES)


def asks_rebuild(path: str) -> bool:
    """needs_rebuild of one path, on the driver."""
    return path in REBUILD or re.search(REBUILD_NAMES, path) is not None


def event_time(c: Column) -> Column:
    return c.cast("timestamp")


def sessions(events: DataFrame, key: str, ts: str, gap: str, watermark: str = "1 day") -> DataFrame:
    """(key, started, ended, events): batches closed by a gap; for batch and streaming tables alike."""
    rows = events.withColumn(ts, event_time(F.col(ts)))
    if events.isStreaming:
        rows = rows.withWatermark(ts, watermark)
    per = rows.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return per.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def batches_by_gap(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Batch form by windows: (key, batch, first, last, events), batches from 0."""
    w = Window.partitionBy(key).orderBy(ts)
    t = F.unix_micros(event_time(F.col(ts)))
    fresh = F.coalesce((t - F.lag(t).over(w) >= seconds * 1_000_000).cast("int"), F.lit(0))
    rows = events.withColumn("fresh", fresh).withColumn("batch", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "batch").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))


def watch_plan(changes: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """Of each batch: different paths, dropped repeats, and whether it asks for a full build."""
    rows = changes.where(watched(F.col(path)))
    return rows.groupBy(*by).agg(F.countDistinct(path).alias("paths"), (F.count(path) - F.countDistinct(path)).alias("repeats"), F.coalesce(F.bool_or(needs_rebuild(F.col(path))), F.lit(False)).alias("rebuild"))


def follow(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, key: str = "path", ts: str = "ts", watermark: str = "10 minutes"):
    """Runs refresh(batch of different changes, number) for each micro-batch. One batch runs at a time and
    what comes meanwhile waits for the next; the checkpoint makes a restart go on where it stopped."""
    rows = stream.withColumn(ts, event_time(F.col(ts))).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key, ts])
    return rows.writeStream.foreachBatch(lambda df, n: refresh(df.dropDuplicates([key]), n)).option("checkpointLocation", checkpoint)


def listing_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changes of two listings (path, size, mtime_ms), removals too, which a file stream does not report."""
    from ..operators.graph import snapshot_diff

    mark = F.concat_ws(":", "size", "mtime_ms")
    return snapshot_diff(previous.withColumn("fingerprint", mark), current.withColumn("fingerprint", mark)).where(watched(F.col("path")))
