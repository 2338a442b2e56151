"""Chunked mining of sessions that are still being written.

Views reach the stream with their number in the session, in any order and in any
batches. Per session the state holds the views of the unfinished chunk, at most
a chunk and its overlap, and views that came before their turn. Whenever the
view behind a chunk is there, the chunk's end is known and the recurrence goes
on from it; the open rest of a session is reported as an unfinished chunk, which
later batches replace. So after every batch the newest version of each chunk is
what a batch run over all views so far would give.

A call of the state operator costs far more than a session, so sessions share a
fixed number of groups, whose state is read and written as two lists. Sessions
that rest are put away under their name and looked up when they go on, so a
batch costs its own sessions and those of the last few batches.

Rules are applied before the state, where they are row-local: the state holds
roles and the few views that a rule fires on, no other text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signalmill.functions.classify import heuristic_signal, heuristic_summary
from signalmill.operators.chunks import CHUNK_EVENTS, CHUNK_OVERLAP
from signalmill.operators.signals import MAX_ITEMS, MAX_SUMMARY, chunk_candidates, validated_hits, without_overlap
from signalmill.streaming.live import latest, with_rocksdb

# Groups that the sessions are dealt to by their hash.
GROUPS = 512
# Batches of its group without a view of a session before it is put away, and the most views of a session put away.
IDLE = 4
MOST_AWAY = 10_000
# Rows that a group hands on at once.
ROWS_OUT = 50_000
_VIEW = "v bigint, role string, hit string"
_CHUNK = "session_id string, chunk_idx bigint, start_v bigint, end_v bigint, complete boolean, hit string"
_HIT = "i bigint, v bigint, role string, text string, kind string, severity string, confidence double, tags array<string>, summary string"
# Roles that belong together, as (earlier, later).
_TOGETHER = {("toolCall", "toolResult"), ("toolResult", "assistant"), ("user", "assistant")}


def hit_views(views: DataFrame) -> DataFrame:
    """session_id, v, role and, where a rule fires, the hit as JSON. Row-local."""
    fired = views.withColumn("_s", F.expr(heuristic_signal("role", "tool", "status", "error_code", "text")))
    hit = F.to_json(
        F.struct("i", "v", "role", "text", "_s.*", F.expr(heuristic_summary("text", MAX_SUMMARY)).alias("summary"))
    )
    return fired.select("session_id", F.col("v").cast("bigint").alias("v"), "role", F.when(F.col("_s").isNotNull(), hit).alias("hit"))


class _Session:
    """Where a session stands: views seen without a gap, start and number of the open chunk, end of the chunk before."""

    def __init__(self, seen: int = 0, start: int = 0, idx: int = 0, covered: int = 0, idle: int = 0):
        self.seen, self.start, self.idx, self.covered, self.idle = seen, start, idx, covered, idle
        # The views from `start` on, and those that came before their turn.
        self.tail: dict[int, tuple] = {}
        self.waiting: dict[int, tuple] = {}

    def put(self, v: int, role: str, hit: str | None) -> None:
        (self.tail if v < self.seen else self.waiting)[v] = (v, role, hit)

    def views(self) -> list[tuple]:
        return [r for part in (self.tail, self.waiting) for _, r in sorted(part.items())]

    def place(self) -> tuple:
        return self.seen, self.start, self.idx, self.covered, self.idle


class _Chunks(StatefulProcessor):
    """The chunk recurrence of each session of a group, resumed where the last batch left it."""

    def __init__(self, size: int, overlap: int, idle: int):
        self.size, self.overlap, self.idle = size, overlap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = "seen bigint, start bigint, idx bigint, covered bigint, idle int"
        self.places = handle.getListState("places", f"session_id string, {place}")
        self.views = handle.getListState("views", f"session_id string, {_VIEW}")
        self.away = handle.getMapState("away", "session_id string", f"{place}, views array<struct<{_VIEW}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = {r[0]: _Session(*r[1:]) for r in (self.places.get() if self.places.exists() else ())}
        for name, v, role, hit in self.views.get() if self.views.exists() else ():
            sessions[name].put(v, role, hit)
        looked_up = self.away.exists()
        added: set[str] = set()
        out: list[tuple] = []
        for part in rows:
            for name, v, role, hit in zip(part["session_id"], part["v"], part["role"], part["hit"], strict=True):
                if name not in sessions:
                    sessions[name] = self._back(name) if looked_up else _Session()
                added.add(name)
                # A view that was there before, in this batch or an earlier one, is the same view.
                if v >= sessions[name].seen:
                    sessions[name].waiting.setdefault(int(v), (int(v), role, hit if isinstance(hit, str) else None))
            # The views that follow without a gap take their turn now, so a file in order leaves nothing waiting.
            for name in part["session_id"].unique():
                self._advance(name, sessions[name], out)
            if len(out) >= ROWS_OUT:
                yield self._rows(out)
                out = []
        for name in added:
            if sessions[name].seen > sessions[name].covered:
                self._report(name, sessions[name], sessions[name].seen, False, out)
        self._keep(sessions, added)
        if out:
            yield self._rows(out)

    def _back(self, name: str) -> _Session:
        """A session that was put away, or a new one."""
        found = self.away.getValue((name,))
        if found is None:
            return _Session()
        self.away.removeKey((name,))
        session = _Session(*found[:5])
        for v, role, hit in found[5]:
            session.put(v, role, hit)
        return session

    def _advance(self, name: str, session: _Session, out: list[tuple]) -> None:
        while session.seen in session.waiting:
            session.tail[session.seen] = session.waiting.pop(session.seen)
            session.seen += 1
            plain = session.start + self.size
            if plain < session.seen:
                tail = session.tail
                end = plain + ((tail[plain - 1][1], tail[plain][1]) in _TOGETHER)
                self._report(name, session, end, True, out)
                session.covered, session.start, session.idx = end, end - self.overlap, session.idx + 1
                session.tail = {x: r for x, r in tail.items() if x >= session.start}

    @staticmethod
    def _report(name: str, session: _Session, end: int, complete: bool, out: list[tuple]) -> None:
        hits = [h for v in range(session.start, end) if (h := session.tail[v][2]) is not None]
        out.extend((name, session.idx, session.start, end, complete, hit) for hit in hits or [None])

    def _keep(self, sessions: dict[str, _Session], added: set[str]) -> None:
        places: list[tuple] = []
        views: list[tuple] = []
        for name, session in sessions.items():
            session.idle = 0 if name in added else session.idle + 1
            own = session.views()
            if session.idle >= self.idle and len(own) <= MOST_AWAY:
                self.away.updateValue((name,), (*session.place(), own))
            else:
                places.append((name, *session.place()))
                views.extend((name, *r) for r in own)
        for state, kept in ((self.places, places), (self.views, views)):
            if kept:
                state.put(kept)
            elif state.exists():
                state.clear()

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["session_id", "chunk_idx", "start_v", "end_v", "complete", "hit"])


def chunk_stream(
    views: DataFrame, size: int = CHUNK_EVENTS, overlap: int = CHUNK_OVERLAP, groups: int = GROUPS, idle: int = IDLE
) -> DataFrame:
    """Chunks of a stream of numbered views: one row per chunk and hit, or one with a NULL hit.

    `views` has session_id, a dense 0-based `v` and what the rules read. A view
    whose number was seen before is ignored, a view ahead of its turn waits.
    `groups` must stay the same over the life of a stream. A session that no view
    is added to in `idle` batches of its group is put away.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    overlap = max(0, min(overlap, size - 1))
    return (
        hit_views(views)
        .withColumn("group", F.pmod(F.xxhash64("session_id"), F.lit(groups)).cast("int"))
        .groupBy("group")
        .transformWithStateInPandas(
            statefulProcessor=_Chunks(size, overlap, idle), outputStructType=_CHUNK, outputMode="Update", timeMode="None"
        )
    )


def mining_writer(path: str, max_items: int = MAX_ITEMS) -> Callable[[DataFrame, int], None]:
    """Batch function for `chunk_stream`: writes the batch's chunks and their validated items."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        bounds = rows.drop("hit").distinct()
        bounds.write.mode("overwrite").parquet(f"{path}/chunks/batch_id={batch_id}")
        hits = rows.filter("hit IS NOT NULL").select("session_id", "chunk_idx", F.from_json("hit", _HIT).alias("h"))
        candidates = chunk_candidates(hits.select("session_id", "chunk_idx", "h.*"), max_items)
        validated_hits(candidates, max_items).write.mode("overwrite").parquet(f"{path}/items/batch_id={batch_id}")
        rows.unpersist()

    return write


def mine_available(
    views: DataFrame,
    path: str,
    checkpoint: str,
    size: int = CHUNK_EVENTS,
    overlap: int = CHUNK_OVERLAP,
    groups: int = GROUPS,
    idle: int = IDLE,
) -> None:
    """Mine what has arrived so far and stop; a later call goes on from there."""
    writer = (
        chunk_stream(views, size, overlap, groups, idle)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(mining_writer(path))
    )
    with_rocksdb(views.sparkSession, writer.start).awaitTermination()


def mined_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that hold after the last batch."""
    schema = "session_id string, chunk_idx bigint, start_v bigint, end_v bigint, complete boolean, batch_id bigint"
    return latest(spark, f"{path}/chunks", ["session_id", "chunk_idx"], schema)


def mined_items(spark: SparkSession, path: str) -> DataFrame:
    """The items that hold after the last batch, once each as in a batch run."""
    written = spark.read.parquet(f"{path}/items")
    schema = "session_id string, chunk_idx bigint, complete boolean, batch_id bigint"
    newest = (
        spark.read.schema(schema).parquet(f"{path}/chunks").groupBy("session_id", "chunk_idx").agg(F.max("batch_id").alias("batch_id"))
    )
    return without_overlap(written.join(newest, ["session_id", "chunk_idx", "batch_id"], "left_semi").drop("batch_id"))
