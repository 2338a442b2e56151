"""Gaps between timestamps on a stream whose rows come out of order.

A session is cut into time buckets, and a bucket of some sessions, dealt by their
hash, is a group of its own: most sessions have few rows in a bucket, and a group
costs much more than a row. Its timestamps wait in a list until an event-time
timer says that the watermark has passed the bucket's end; then they are released
in order with the gaps between those of a session. So no worker ever sorts a
session, and a session with most of the rows spreads over as many tasks as it has
buckets.

The gap before a bucket's first timestamp needs the last one of the bucket
before. Buckets are released in the order of their ends, so a small table with
the last released timestamp per session is carried from batch to batch.

A row whose bucket was released before it came is late: it is reported at once,
marked and without a gap. What the watermark has not passed yet is reported by
`settled` as if the stream ended here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signalmill.operators.cron import RAPID_MS
from signalmill.operators.stable import stable
from signalmill.streaming.live import with_rocksdb

_RELEASED = "session_id string, bucket bigint, micros bigint, inside bigint, late boolean"
# Timestamps per row of the state, and rows per part of the result.
_PACK = 10_000
# Groups that the sessions of a bucket are dealt to.
SHARDS = 16


class _Buckets(StatefulProcessor):
    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Timestamps in packs, so that a pack and not a row is one entry of the store.
        self.packs = handle.getListState("packs", "sessions array<string>, micros array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = (int(key[1]) + 1) * self.width_ms
        if timerValues.getCurrentWatermarkInMs() >= end:
            for part in rows:
                yield _frame(key, part["session_id"].to_numpy(object), part["micros"].to_numpy(np.int64), None, True)
            return
        if not self.packs.exists():
            self.handle.registerTimer(end)
        for part in rows:
            sessions, micros = part["session_id"].tolist(), part["micros"].tolist()
            for at in range(0, len(micros), _PACK):
                self.packs.appendValue((sessions[at : at + _PACK], micros[at : at + _PACK]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packs = list(self.packs.get())
        self.packs.clear()
        sessions = np.concatenate([np.asarray(p[0], object) for p in packs])
        micros = np.concatenate([np.asarray(p[1], np.int64) for p in packs])
        codes = pd.factorize(sessions)[0]
        order = np.lexsort((micros, codes))
        sessions, micros, codes = sessions[order], micros[order], codes[order]
        gaps = np.concatenate(([None], np.diff(micros).astype(object)))
        gaps[1:][codes[1:] != codes[:-1]] = None
        for at in range(0, len(micros), _PACK):
            part = slice(at, at + _PACK)
            yield _frame(key, sessions[part], micros[part], gaps[part], False)


def _frame(key: tuple, sessions: np.ndarray, micros: np.ndarray, inside, late: bool) -> pd.DataFrame:
    gaps = pd.array([None] * len(micros) if inside is None else list(inside), dtype="Int64")
    return pd.DataFrame({"session_id": sessions, "bucket": int(key[1]), "micros": micros, "inside": gaps, "late": late})


def released(cron: DataFrame, delay: str = "1 hour", width_ms: int = 3_600_000) -> DataFrame:
    """Rows of a stream (session_id, ts) in the order of time inside their bucket, once it is over."""
    timed = cron.select("session_id", "ts").withWatermark("ts", delay)
    micros = F.unix_micros("ts")
    shard = F.pmod(F.xxhash64("session_id"), F.lit(SHARDS)).alias("shard")
    dealt = timed.select(shard, F.floor(micros / (width_ms * 1000)).alias("bucket"), "session_id", micros.alias("micros"))
    return dealt.groupBy("shard", "bucket").transformWithStateInPandas(
        statefulProcessor=_Buckets(width_ms), outputStructType=_RELEASED, outputMode="Append", timeMode="EventTime"
    )


def _with_gaps(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Add gap_ms: inside the bucket as it is, for the first row of a bucket from the bucket before or `carried`."""
    keys = ["session_id", "bucket"]
    first = F.col("inside").isNull() & ~F.col("late")
    edges = rows.filter("NOT late").groupBy(*keys).agg(F.max("micros").alias("newest"))
    # One short row per bucket.
    before = F.lag("newest").over(Window.partitionBy("session_id").orderBy("bucket"))
    opened = edges.withColumn("before", before).join(carried, "session_id", "left")
    opened = opened.select(*keys, F.coalesce("before", "last").alias("before"))
    joined = rows.withColumn("first", first).join(opened.withColumn("first", F.lit(True)), [*keys, "first"], "left")
    gap = F.coalesce(F.col("inside"), F.when(F.col("first"), F.col("micros") - F.col("before"))) / 1000
    told = joined.select("session_id", F.timestamp_micros("micros").alias("ts"), gap.alias("gap_ms"), "late")
    return told.withColumn("rapid", F.coalesce(F.col("gap_ms") < RAPID_MS, F.lit(False)))


def _carried(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The last released timestamp of each session."""
    rows = spark.read.schema("session_id string, last bigint, batch_id bigint").parquet(f"{path}/carry")
    rows = rows if below is None else rows.filter(F.col("batch_id") < below)
    return rows.groupBy("session_id").agg(F.max("last").alias("last"))


def gap_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function for `released`: writes the rows with their gaps, and what the next batch needs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        carry = f"{path}/carry/batch_id={batch_id}"
        newest = rows.filter("NOT late").groupBy("session_id").agg(F.max("micros").alias("last"))
        newest.write.mode("overwrite").parquet(carry)
        _with_gaps(rows, _carried(spark, path, batch_id)).write.mode("overwrite").parquet(f"{path}/gaps/batch_id={batch_id}")
        rows.unpersist()

    return write


def release_available(cron: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", width_ms: int = 3_600_000) -> None:
    """Take in what has arrived, write what the watermark has passed, and stop; a later call goes on from there."""
    writer = (
        released(cron, delay, width_ms)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(gap_writer(path))
    )
    with_rocksdb(cron.sparkSession, writer.start).awaitTermination()


def settled(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """All rows so far: those written, and those that still wait in the state as if the stream ended here."""

    def waiting() -> DataFrame:
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "packs").load()
        rows = state.select("key.bucket", F.explode(F.arrays_zip("list_element.sessions", "list_element.micros")).alias("row"))
        packs = rows.select(F.col("row.sessions").alias("session_id"), "bucket", "row.micros")
        earlier = F.lag("micros").over(Window.partitionBy("session_id", "bucket").orderBy("micros"))
        rows = packs.withColumn("inside", F.col("micros") - earlier).withColumn("late", F.lit(False))
        return stable(_with_gaps(rows, _carried(spark, path)))

    columns = ["session_id", "ts", "gap_ms", "late", "rapid"]
    written = spark.read.schema("session_id string, ts timestamp, gap_ms double, late boolean, rapid boolean").parquet(f"{path}/gaps")
    return written.select(*columns).unionByName(with_rocksdb(spark, waiting).select(*columns))
