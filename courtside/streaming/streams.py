"""Live snapshots as streams (ST1-ST5). Every operator has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courtside.functions.text import trim
from courtside.operators.keys import join_on, pick_first
from courtside.operators.merge import merge_versions
from courtside.operators.stages import final_ok
from courtside.session import checkpoint_location
from courtside.sources.paths import present

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that state with timers needs


def latest_best(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of the newest version of each event in a ``stream_latest_best`` table; None while it is empty."""
    if not present(spark, path):
        return None
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    # a full version holds every event, so nothing older is read
    (base,) = rows.filter(F.col("full") == 1).agg(F.max("version")).first()
    rows = rows.filter(F.col("version") >= (base or 0)).drop("full", "bucket")
    newest = rows.groupBy("event").agg(F.max("version").alias("__newest"))
    return join_on(rows, newest, ["event"], "inner").filter(F.col("version") == F.col("__newest")).drop("__newest")


def stream_latest_best(snapshots: DataFrame, path: str, key: Column, better: Sequence[Column],
                       checkpoint: str | None = None, full_every: int = 100, buckets: int = 64):
    """ST1: keeps, per event and code, the best version seen so far; a later, weaker version never replaces it.

    A batch writes the events it touches under its own batch id and reads only earlier ids, so a batch that runs again
    after a failure writes the same rows to the same place. Every ``full_every``-th batch writes all events. Events
    share ``buckets`` folders per batch.
    """
    spark = snapshots.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        # several versions of a code in one batch: the best, on a tie the latest
        best = pick_first(batch, ["event", F.nullif(key, F.lit("")), F.when(F.coalesce(key, F.lit("")) == "",
                                                                          F.col("seq"))],
                          [*better, F.col("seq").desc()])
        stored = latest_best(spark, path, before=batch_id)
        full = stored is not None and batch_id % full_every == full_every - 1
        if stored is None:
            merged = best
        else:
            touched = batch.select("event").distinct()
            current = stored.drop("version")
            if not full:
                current = join_on(current, touched, ["event"], "left_semi")
            merged = merge_versions(best, current, ["event"], key, "seq", better).drop("merged_seq")
        (merged.withColumns({"version": F.lit(batch_id), "full": F.lit(int(full)),
                             "bucket": F.pmod(F.xxhash64("event"), F.lit(buckets))})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("version", "full", "bucket").parquet(path))

    return snapshots.writeStream.foreachBatch(merge).option(
        "checkpointLocation", checkpoint_location(spark, path, checkpoint))


def stream_dedupe(items: DataFrame, code: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """ST2: first item of a code, repeats dropped while they come within ``delay``."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(code))


def fresh_snapshots(snapshots: DataFrame, event: str, fetched_at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """ST3, batch: newest snapshot of each event, when it is younger than the TTL."""
    newest = snapshots.groupBy(event).agg(F.max(fetched_at).alias(fetched_at))
    return newest.filter(F.col(fetched_at) > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def stream_expire(snapshots: DataFrame, event: str, fetched_at: str, ttl_seconds: int, delay: str) -> DataFrame:
    """ST3: (event, fetched_at, state): "fresh" when a newer snapshot arrives, "expired" once the watermark passes its
    TTL."""
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({event: [key[0]], fetched_at: [pd.Timestamp(at, unit="us")], "state": ["expired"]})
            return
        newest = max(f[fetched_at].max() for f in frames)
        known = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if known is not None and newest <= known:
            return
        state.update((int(newest.value // 1000),))
        deadline = int((newest + ttl).value // 1_000_000)
        if deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
            yield pd.DataFrame({event: [key[0]], fetched_at: [newest], "state": ["fresh"]})
        else:
            state.remove()
            yield pd.DataFrame({event: [key[0]], fetched_at: [newest], "state": ["expired"]})

    kind = dict(snapshots.dtypes)[event]
    return snapshots.withWatermark(fetched_at, delay).groupBy(event).applyInPandasWithState(
        step, f"`{event}` {kind}, `{fetched_at}` timestamp, state string", "at bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


class _OverLimit(StatefulProcessor):
    """The open window of a key, and its events that the watermark has not reached.

    An event counts once the watermark has passed it, for then nothing earlier can come; a timer at the earliest event that
    waits brings it about. A last timer at the end of the window removes the key.
    """

    def __init__(self, ts: str, tie: str, length: int, maximum: int):
        self.ts, self.tie, self.length, self.maximum = ts, tie, length, maximum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, count bigint")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _at(self, pdf: pd.DataFrame) -> np.ndarray:
        return pdf[self.ts].astype("datetime64[us]").astype("int64").to_numpy()

    def _keep(self, pdf: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(pdf, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-int(micros) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([(self._keep(pdf),)])
                self._wake(self._at(pdf).min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        frames = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.waiting.get()] if self.waiting.exists() else []
        start, count = self.window.get() if self.window.exists() else (None, 0)
        if frames:
            pdf = pd.concat(frames, ignore_index=True).sort_values([self.ts, self.tie], kind="stable", ignore_index=True)
            ready = int(np.searchsorted(self._at(pdf), reached, side="right"))
            if ready or len(frames) > 1:
                self.waiting.clear()
                if ready < len(pdf):
                    self.waiting.put([(self._keep(pdf.iloc[ready:]),)])
                    self._wake(self._at(pdf)[ready])
            if ready:
                pdf = pdf.iloc[:ready]
                starts, counts = np.empty(ready, dtype=np.int64), np.empty(ready, dtype=np.int64)
                at, first = self._at(pdf), 0
                while first < ready:
                    if start is None or at[first] - start >= self.length:
                        start, count = int(at[first]), 0
                    end = int(np.searchsorted(at, start + self.length, side="left"))
                    starts[first:end], counts[first:end] = start, count + 1 + np.arange(end - first)
                    first, count = end, count + end - first
                self.window.update((start, count))
                self._wake(start + self.length)
                yield pdf.assign(window_start=starts, window_count=counts, over_limit=counts > self.maximum)
        if start is not None and reached >= start + self.length:
            self.window.clear()

    def close(self) -> None:
        pass


def stream_over_limit(events: DataFrame, key: str, ts: str, tie: str, length_seconds: int, maximum: int,
                      delay: str = "0 seconds") -> DataFrame:
    """ST4: W5 on a stream. Events may come out of order within ``delay``; each is given out once the watermark has passed it,
    later ones are dropped. What is kept of a key goes when the watermark passes the end of its window."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes)
    processor = _OverLimit(ts, tie, length_seconds * 1_000_000, maximum)
    return events.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(
        processor, f"{schema}, window_start bigint, window_count bigint, over_limit boolean", "Append", "EventTime")


def stream_category_finals(matches: DataFrame, category: Column, ok: Column | None = None) -> DataFrame:
    """ST5, first step: per event and category whether an official final has been seen; use update mode."""
    ok = final_ok(F.col("roundKey"), F.col("roundLabel"), F.col("resultStatus")) if ok is None else ok
    named = matches.withColumn("category", trim(category)).filter(F.col("category") != "")
    return named.groupBy("event", "category").agg(F.max(F.coalesce(ok, F.lit(False))).alias("ok"))


def stream_finished_events(matches: DataFrame, path: str, category: Column, ok: Column | None = None,
                           checkpoint: str | None = None):
    """ST5: changed categories of every batch are written under the batch id; ``finished_events`` reads them."""
    spark = matches.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))

    return (stream_category_finals(matches, category, ok).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint_location(spark, path, checkpoint)))


def finished_events(spark: SparkSession, path: str) -> DataFrame:
    """ST5: a category once final stays final, so the versions of a category are simply or-ed."""
    per_category = spark.read.parquet(path).groupBy("event", "category").agg(F.bool_or("ok").alias("ok"))
    return per_category.groupBy("event").agg(F.bool_and("ok").alias("finished"))


def available_now(writer, sink: Callable | None = None) -> None:
    """Runs a stream over what is there and waits for it."""
    (sink(writer) if sink else writer).trigger(availableNow=True).start().awaitTermination()
