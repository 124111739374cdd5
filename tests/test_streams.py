import os
import pathlib

import pytest
from pyspark.sql import functions as F

from courtside.operators import anchored, merge, stages
from courtside.session import checkpoint_location
from courtside.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def parts(spark, tmp_path):
    """The events table in three files of consecutive events."""
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    size = events.count() // 3 + 1
    for i in range(3):
        rows = events.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def to_memory(df, name, tmp_path, mode="append"):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("cp_" + name)))
    streams.available_now(writer)


def test_dedupe(spark, parts, tmp_path):
    events, stream = parts
    keyed = stream.select("event_type", (F.col("event_id") % 7).alias("code"), "ts")
    to_memory(streams.stream_dedupe(keyed, ["event_type", "code"], "ts", "3650 days"), "deduped", tmp_path)
    got = spark.table("deduped").select("event_type", "code")
    assert got.count() == got.distinct().count() == events.select("event_type", F.col("event_id") % 7).distinct().count()


@pytest.fixture
def disordered(spark, tmp_path):
    """Events in files by time, each moved by up to two hours, then one that moves the watermark past all others."""
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts")
    order = F.unix_seconds("ts") + F.pmod(F.hash("event_id"), F.lit(7200))
    low, high = events.agg(F.min(order), F.max(order)).first()
    last = spark.createDataFrame([(-1, -1)], "event_id long, user_id long").select("event_id", "user_id", F.lit("2100-01-01").cast("timestamp").alias("ts"))
    parts = 5
    for i in range(parts):
        share = F.floor((order - low) / F.lit((high - low + 1) / parts))
        events.filter(share == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_over_limit_equals_batch(spark, disordered, tmp_path):
    """Out of order within the watermark, the stream gives what the batch gives, and its state goes."""
    events, stream = disordered
    out = streams.stream_over_limit(stream, "user_id", "ts", "event_id", 6 * 3600, 3, "2 hours")
    writer = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp_limited"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    batch = anchored.anchored_window_count(events, "user_id", "ts", "event_id", 6 * 3600, 3)
    columns = ["event_id", "window_start", "window_count", "over_limit"]
    assert sorted(map(tuple, spark.table("limited").filter("event_id >= 0").select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) > 10 and kept[-1] <= 4, kept  # the last event waits alone, with its timer


def test_expire_equals_batch(spark, parts, tmp_path):
    events, stream = parts
    ttl = 3 * 24 * 3600
    out = streams.stream_expire(stream.select(F.col("event_type").alias("event"), F.col("ts").alias("fetched_at")), "event", "fetched_at", ttl, "0 seconds")
    to_memory(out, "expiry", tmp_path)
    newest = spark.table("expiry").filter("state = 'fresh'").groupBy("event").agg(F.max("fetched_at").alias("fetched_at"))
    batch = streams.fresh_snapshots(events.withColumnRenamed("event_type", "event"), "event", "ts", F.lit(events.agg(F.max("ts")).first()[0]), ttl)
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, batch.select("event", "ts").collect()))


@pytest.mark.parametrize("full_every", [2, 100])
def test_latest_best_equals_batch_and_survives_a_rerun(spark, parts, tmp_path, full_every):
    events, stream = parts

    def snapshot(df):
        return df.select(F.col("event_type").alias("event"), (F.col("user_id") % 5).cast("string").alias("code"), F.col("event_id").alias("seq"),
                         (F.col("event_id") % 11).alias("rank"))

    better, path = [F.col("rank").desc()], str(tmp_path / "best")
    streams.available_now(streams.stream_latest_best(snapshot(stream), path, F.col("code"), better, str(tmp_path / "cp"), full_every))
    best = merge.pick_first(snapshot(events), ["event", "code"], [*better, F.col("seq").desc()])
    columns = ["event", "code", "rank"]

    def stored():
        return sorted(map(tuple, streams.latest_best(spark, path).select(columns).collect()))

    want = sorted(map(tuple, best.select(columns).collect()))
    assert stored() == want
    # the last batch runs again after a lost commit
    commits = pathlib.Path(checkpoint_location(spark, path, str(tmp_path / "cp"))) / "commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if (commits / name).exists():
            os.remove(commits / name)
    streams.available_now(streams.stream_latest_best(snapshot(stream), path, F.col("code"), better, str(tmp_path / "cp"), full_every))
    assert stored() == want


def test_finished_events_equal_batch(spark, parts, tmp_path):
    events, stream = parts

    def named(df):
        return df.select((F.col("user_id") % 4).cast("string").alias("event"), F.col("event_type").alias("kind"), "value")

    ok = F.col("value") > 120
    path = str(tmp_path / "done")
    streams.available_now(streams.stream_finished_events(named(stream), path, F.col("kind"), ok, str(tmp_path / "cp")))
    batch = stages.event_finished(named(events), ["event"], F.col("kind"), ok)
    assert sorted(map(tuple, streams.finished_events(spark, path).collect())) == sorted(map(tuple, batch.select("event", "finished").collect()))
