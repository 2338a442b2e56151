"""The row-local steps of the batch path on streams, windowed operators, and what stateful ones share.

Chunked mining is in `mining`, gaps are in `gaps`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.text import session_key
from signalmill.operators.events import event_views
from signalmill.operators.signals import heuristic_hits
from signalmill.operators.tickets import existing_fingerprints, ticket_creates, ticket_ir, ticket_updates
from signalmill.sources.sessions import parse_events, rel_path


def session_stream(
    spark: SparkSession,
    root: str,
    files_per_trigger: int = 1000,
    name_glob: str = "*.jsonl",
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Normalised events of session files as they arrive below `root`.

    A batch costs a look at every file that is left, so a folder of many small
    files is better read in batches of `bytes_per_trigger`, whatever their number.
    """
    limit = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    lines = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_glob)
        .option(*limit)
        .text(root)
        .select(rel_path(F.col("_metadata.file_path"), root).alias("rel_path"), "value")
        .select(F.expr(session_key("rel_path")).alias("session_id"), "value")
    )
    return event_views(parse_events(lines))


def signal_stream(views: DataFrame) -> DataFrame:
    """Rule hits of a view stream with an event time `ts`. Row-local."""
    return heuristic_hits(views.withColumn("i", F.lit(0))).drop("i")


def daily_counts(hits: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Signals per kind in tumbling windows; rows later than `delay` are dropped."""
    return (
        hits.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "kind")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "kind", "n")
    )


def distinct_items(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Items without repeats of the same content id inside the watermark."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["item_id"])


_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_rocksdb[T](spark: SparkSession, start: Callable[[], T]) -> T:
    """Start a query whose operators keep lists, maps and timers, or read their state: the RocksDB store holds it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str) -> None:
    """Process what has arrived so far and stop. `write(batch, id)` must accept a repeated batch."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def parquet_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes every batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """The newest version of each key among the batches of an update-mode sink."""
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return newest.select(*keys, "r.*")


def ticket_writer(tickets: Callable[[], DataFrame], path: str, **limits) -> Callable[[DataFrame, int], None]:
    """Batch function for a stream of clusters: writes updates and creates of each batch.

    `tickets` reads the current ticket table, so that a batch sees those made before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = existing_fingerprints(tickets())
        updates = ticket_updates(batch, known).select("ticket_id", "fingerprint_id", "comment")
        creates = ticket_ir(ticket_creates(batch, known, **limits)).drop("first_pos")
        updates.write.mode("overwrite").parquet(f"{path}/updates/batch_id={batch_id}")
        creates.write.mode("overwrite").parquet(f"{path}/creates/batch_id={batch_id}")

    return write
