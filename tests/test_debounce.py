"""The stateful debounce, stopped and started again on one checkpoint, against batches by windows."""

import pytest
from pyspark.sql import functions as F

from stratalens.streaming import changes, debounce

SCHEMA = "event_id long, user_id long, ts timestamp, path string"


@pytest.fixture
def store(spark):
    for k, v in debounce.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in debounce.STORE:
        spark.conf.unset(k)


def test_restarts_give_the_batches_of_the_whole_feed(spark, sf, tmp_path, store):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null and ts is not null")
    events = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 50 == 0, "package.json").otherwise(F.concat(F.lit("src/"), "event_type")).alias("path"))
    ids = [r.user_id for r in events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(12).collect()]
    rows = sorted(events.where(F.col("user_id").isin(ids)).collect(), key=lambda r: (r.ts, r.event_id))
    feed, seen = tmp_path / "in", []

    def refresh(df, n):
        seen.extend(df.collect())

    third = -(-len(rows) // 3)
    for k in range(3):  # files come in order of time; each start reads one more and goes on from the checkpoint
        spark.createDataFrame(rows[k * third : (k + 1) * third], SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema(SCHEMA).parquet(str(feed))
        closed = debounce.debounced(stream, "user_id", "ts", "path", 6 * 3600)
        q = closed.writeStream.foreachBatch(refresh).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    gap = 6 * 3600
    last = max(r.ts for r in rows).timestamp()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {(str(r.user_id), r.batch): (r.first, r.last, r.events) for r in changes.batches_by_gap(frame, "user_id", "ts", gap).collect()}
    got = {(r.key, r.batch): (r["first"], r["last"], r.events) for r in seen}
    assert len(got) == len(seen)
    assert got.items() <= want.items()
    assert {k for k, v in want.items() if v[1].timestamp() + gap < last} <= got.keys()
    assert all(r.rebuild == ("package.json" in r.paths) and r.paths == sorted(set(r.paths)) for r in seen)


def test_one_batch_is_queued(spark):
    rows = [("a", 0, ["x", "y"], 2, False), ("a", 1, ["y", "z"], 3, True), ("b", 4, [], 1, False)]
    df = spark.createDataFrame(rows, "key string, batch long, paths array<string>, events long, rebuild boolean").withColumns({"first": F.current_timestamp(), "last": F.current_timestamp()})
    got = {r.key: (r.batch, r.paths, r.events, r.rebuild) for r in debounce.one_queued(df).collect()}
    assert got == {"a": (0, ["x", "y", "z"], 5, True), "b": (4, [], 1, False)}
