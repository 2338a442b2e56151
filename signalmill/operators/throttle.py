"""A rate limit per session: a row is kept if it comes at least some time after the last kept one.

Which rows are kept depends on the kept ones before them. To run this in
parallel, rows are numbered in the order of time and cut into blocks. Inside a
block every row points to the first row that may follow it, and pointer doubling
finds the last kept row of the block for each row that could be the first. A
block thus becomes a short table from the time at which rows are allowed again
to the time at which they are after it. One short row per block is chained in
the order of time; then every block marks its own rows. No step holds more than
a block of rows at once, or one batch of rows from smaller blocks, whatever the
session. Blocks are sorted and run through a task one after the other, since a
call of Python for each costs far more than a short block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.ordered import BLOCK, ranked
from signalmill.operators.pairing import groups_of, starts_of
from signalmill.operators.stable import stable

MIN_GAP_MS = 30_000
_NEVER = -(1 << 62)


def _following(micros: np.ndarray, gap: int) -> np.ndarray:
    """The first row that may be kept after each row; the number of rows for none."""
    return np.searchsorted(micros, micros + gap, side="left")


def _last_kept(micros: np.ndarray, gap: int) -> np.ndarray:
    """The last row that is kept if row i is, by pointer doubling."""
    after = _following(micros, gap)
    reach = np.where(after < len(micros), after, np.arange(len(micros)))
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return reach
        reach = further


def _summary(micros: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, then): rows that are allowed again from a time <= upto[k] on are so from then[k] on after the block.

    A time behind all rows stays as it is. What comes into a block is at most a
    gap later than its first row, so the table ends there; equal ends are one entry.
    """
    then = micros[_last_kept(micros, gap)] + gap
    needed = min(len(micros), int(np.searchsorted(micros, micros[0] + gap, side="left")) + 1)
    last = np.append(np.flatnonzero(then[1:needed] != then[: needed - 1]), needed - 1)
    return micros[last], then[last]


def _sorted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, order)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups, with the first row of each group and the number of rows."""
    for rows in groups_of(batches, keys):
        yield rows, [*starts_of(rows, keys).tolist(), rows.num_rows]


def throttled(
    rows: DataFrame,
    tie: str,
    min_gap_ms: int = MIN_GAP_MS,
    since: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add `kept` to rows with session_id and ts; of rows at the same time the one with the least `tie` comes first.

    `since` (session_id, last) has the microsecond of the last row that was
    kept before these rows. A row without a session or a time is not kept.
    """
    gap = min_gap_ms * 1000
    session = dict(rows.dtypes)["session_id"]
    known = rows.filter("session_id IS NOT NULL AND ts IS NOT NULL")
    numbered = stable(ranked(known, ["session_id"], ["ts", tie], "_at"))
    narrow = numbered.select("session_id", F.expr(f"_at div {block}").alias("block"), "_at", F.unix_micros("ts").alias("micros"))
    keys = ["session_id", "block"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, keys):
            micros = rows.column("micros").to_numpy()
            found = [_summary(micros[at:end], gap) for at, end in zip(starts, starts[1:], strict=False)]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            short = rows.select(keys).take(pa.array(starts[:-1]))
            yield from short.append_column("upto", lists[0]).append_column("then", lists[1]).to_batches()

    blocks = _sorted(narrow, keys, "_at").mapInArrow(summarise, f"session_id {session}, block bigint, upto array<bigint>, then array<bigint>")
    blocks = blocks.withColumn("start", F.lit(None).cast("bigint"))
    if since is not None:
        blocks = blocks.drop("start").join(since.select("session_id", (F.col("last") + gap).alias("start")), "session_id", "left")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One short row per block of a session, in the order of time.
        for rows, starts in _groups(batches, ["session_id"]):
            upto, then, since, entries = rows.column("upto"), rows.column("then"), rows.column("start").to_pylist(), []
            for at, end in zip(starts, starts[1:], strict=False):
                allowed = _NEVER if since[at] is None else since[at]
                for row in range(at, end):
                    entries.append(allowed)
                    if row + 1 < end:
                        place = int(np.searchsorted(upto[row].values.to_numpy(), allowed, side="left"))
                        allowed = then[row][place].as_py() if place < len(then[row]) else allowed
            yield from rows.select(keys).append_column("allowed", pa.array(entries, pa.int64())).to_batches()

    entries = _sorted(blocks, ["session_id"], "block").mapInArrow(chain, f"session_id {session}, block bigint, allowed bigint")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, keys):
            allowed, micros = rows.column("allowed").to_numpy(), rows.column("micros").to_numpy()
            kept = np.zeros(len(micros), bool)
            for at, end in zip(starts, starts[1:], strict=False):
                own = micros[at:end]
                after = _following(own, gap)
                row = int(np.searchsorted(own, allowed[at], side="left"))
                while row < len(own):
                    kept[at + row] = True
                    row = int(after[row])
            yield from rows.select(["session_id", "_at"]).filter(pa.array(kept)).to_batches()

    marked = _sorted(narrow.join(entries, keys), keys, "_at").mapInArrow(mark, f"session_id {session}, _at bigint")
    told = numbered.join(marked.withColumn("kept", F.lit(True)), ["session_id", "_at"], "left")
    told = told.select(*rows.columns, F.coalesce("kept", F.lit(False)).alias("kept"))
    return told.unionByName(rows.filter("session_id IS NULL OR ts IS NULL").withColumn("kept", F.lit(False)))


def throttle_writer(path: str, tie: str, min_gap_ms: int = MIN_GAP_MS) -> Callable[[DataFrame, int], None]:
    """Batch function for a stream of (session_id, ts, ...) whose batches follow each other in time.

    Writes each batch with `kept` and the last kept time of its sessions, from
    which the next batch goes on. A repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        since = _kept_before(batch.sparkSession, path, batch_id)
        told = throttled(batch, tie, min_gap_ms, since).persist()
        told.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        last = told.filter("kept").groupBy("session_id").agg(F.max(F.unix_micros("ts")).alias("last"))
        last.write.mode("overwrite").parquet(f"{path}/last/batch_id={batch_id}")
        told.unpersist()

    return write


def _kept_before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    if batch == 0:
        return None
    rows = spark.read.schema("session_id string, last bigint, batch_id bigint").parquet(f"{path}/last")
    return rows.filter(F.col("batch_id") < batch).groupBy("session_id").agg(F.max("last").alias("last"))
