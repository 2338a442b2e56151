"""The newest latency samples per phase, kept on a stream.

The samples of a phase are dealt to `salts` keys by their call id, and each key
keeps its own newest `limit` samples: the newest of the phase are among them, in
whatever order and batches samples come. So the state has `limit` * `salts`
samples per phase at most, and a phase with most of the rows spreads over as
many tasks. Reading merges the keys of a phase.

A sample expires when it is older than the newest one of its phase by more than
`keep_days`. A key drops what is too old against its own newest sample, which is
never newer than the phase's; reading drops the rest.

Every key also counts all its samples, kept or not. A sample without a start
time or a call id is counted and not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signalmill.operators.latency import KEEP_LAST
from signalmill.operators.ordered import first_per_key
from signalmill.operators.stable import stable
from signalmill.streaming.live import with_rocksdb

SALTS = 16
_DAY = 86_400_000_000
_KEPT = "micros array<bigint>, calls array<bigint>, latencies array<double>"


class _Newest(StatefulProcessor):
    def __init__(self, limit: int, keep_days: int | None):
        self.limit = limit
        self.keep = None if keep_days is None else keep_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The newest samples as three columns, newest first, and the counters.
        self.kept = handle.getValueState("kept", _KEPT)
        self.counted = handle.getValueState("counted", "success bigint, failure bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        micros, calls, latencies = self.kept.get() if self.kept.exists() else ([], [], [])
        best = pd.DataFrame({"micros": np.array(micros, np.int64), "call_id": np.array(calls, np.int64), "latency_ms": np.array(latencies, np.float64)})
        success, failure = self.counted.get() if self.counted.exists() else (0, 0)
        for part in rows:
            success += int((part["success"] == True).sum())  # noqa: E712
            failure += int((part["success"] == False).sum())  # noqa: E712
            whole = part.dropna(subset=["micros", "call_id"])[["micros", "call_id", "latency_ms"]]
            whole = whole.astype({"micros": np.int64, "call_id": np.int64, "latency_ms": np.float64})
            # A key never holds more than its own samples and a part of the batch.
            best = self._newest(pd.concat([best, whole], ignore_index=True))
        missing = best["latency_ms"].isna().to_numpy()
        told = [None if gone else float(x) for x, gone in zip(best["latency_ms"], missing, strict=True)]
        self.kept.update((best["micros"].tolist(), best["call_id"].tolist(), told))
        self.counted.update((success, failure))
        yield pd.DataFrame({"phase": [key[0]], "salt": [int(key[1])], "kept": [len(best)]})

    def _newest(self, samples: pd.DataFrame) -> pd.DataFrame:
        if self.keep is not None and len(samples):
            samples = samples[samples["micros"] >= samples["micros"].max() - self.keep]
        return samples.sort_values(["micros", "call_id"], ascending=False).head(self.limit)


def keep_available(
    samples: DataFrame, checkpoint: str, limit: int = KEEP_LAST, keep_days: int | None = None, salts: int = SALTS
) -> None:
    """Take in the samples that have arrived and stop; a later call goes on from there.

    Needs phase, start_ts, call_id (an integer), latency_ms and success. The
    stream's checkpoint is the store: `last_samples` and `counters` read it.
    """
    dealt = samples.select(
        "phase",
        F.coalesce(F.pmod(F.xxhash64("call_id"), F.lit(salts)), F.lit(0)).cast("int").alias("salt"),
        F.unix_micros(F.col("start_ts").cast("timestamp")).alias("micros"),
        F.col("call_id").cast("bigint").alias("call_id"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        "success",
    )
    kept = dealt.groupBy("phase", "salt").transformWithStateInPandas(
        statefulProcessor=_Newest(limit, keep_days),
        outputStructType="phase string, salt int, kept bigint",
        outputMode="Update",
        timeMode="None",
    )
    writer = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop")
    with_rocksdb(samples.sparkSession, writer.start).awaitTermination()


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    def read() -> DataFrame:
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        return stable(rows.select("key.phase", "value.*"))

    return with_rocksdb(spark, read)


def last_samples(spark: SparkSession, checkpoint: str, limit: int = KEEP_LAST, keep_days: int | None = None) -> DataFrame:
    """phase, start_ts, call_id, latency_ms: the newest samples of each phase, `limit` at most, none expired.

    `limit` and `keep_days` may be smaller than those that the stream was started with.
    """
    state = _state(spark, checkpoint, "kept")
    rows = state.select("phase", F.explode(F.arrays_zip("micros", "calls", "latencies")).alias("s"))
    rows = rows.select(
        "phase", F.timestamp_micros("s.micros").alias("start_ts"), F.col("s.calls").alias("call_id"), F.col("s.latencies").alias("latency_ms")
    )
    if keep_days is not None:
        newest = rows.groupBy("phase").agg(F.max("start_ts").alias("_newest")).withColumnRenamed("phase", "_phase")
        rows = rows.join(newest, F.col("phase").eqNullSafe(F.col("_phase")))
        rows = rows.filter(F.unix_micros("start_ts") >= F.unix_micros("_newest") - keep_days * _DAY).drop("_phase", "_newest")
    return first_per_key(rows, ["phase"], [F.desc("start_ts"), F.desc("call_id")], limit).drop("_rank")


def counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Successes and failures per phase, over all samples that came."""
    state = _state(spark, checkpoint, "counted")
    return state.groupBy("phase").agg(F.sum("success").alias("success_count"), F.sum("failure").alias("failure_count"))
