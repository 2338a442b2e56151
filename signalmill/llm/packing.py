"""Best-fit packing after a dominance reduction.

Documents become pieces of at most `capacity` tokens. Packing only depends on
how many pieces there are of each length, a table of at most `capacity` rows,
so the plan is made on that table: patterns of lengths, and how many sequences
use each. First the reduction of Martello and Toth fixes small sets that are
provably as good as any other set with their largest piece, then best fit,
longest first, packs what remains. Pieces then look up their place by their
rank among the pieces of their length; no sequence is ever gathered.

Ranks need no sorting: a task numbers its own pieces of a length, and a table
of counts by task and length carries the numbers on. A length that most pieces
share is spread over as many join keys as there are tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.common import kept, pieces_of, texts_of
from signalmill.llm.tokens import worker_encoder

CAPACITY = 1024
END = 2

# A pattern of piece lengths, and the number of sequences that follow it.
Plan = list[tuple[tuple[int, ...], int]]


def pieces(
    docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
    path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut only where longer than `capacity`.

    Every row is a document, also one without id or text, which has the end id
    only. The first piece of a cut document holds what the others leave.
    """

    name = text if text != id else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = worker_encoder(path), np.zeros(capacity + 1, np.int64)
        part, last = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        for batch in pieces_of(batches, name):
            rows: list[tuple] = []
            ids_out: list[np.ndarray] = []
            for k, ids in enumerate(encoder.encode(texts_of(batch, name))):
                ids += last
                total, piece, start = len(ids) // 4, 0, 0
                while start < total:
                    size = (total - start - 1) % capacity + 1
                    own = ids[4 * start : 4 * (start + size)]
                    rows.append((k, piece, start, size, zlib.crc32(own), part, seen[size]))
                    if with_ids:
                        ids_out.append(np.frombuffer(own, "<u4").astype(np.int32))
                    seen[size] += 1
                    start, piece = start + size, piece + 1
            numbers = np.array(rows, np.int64).reshape(-1, 7).T
            columns = [batch.column(0).take(pa.array(numbers[0])), pa.array(numbers[1].astype(np.int32))]
            columns += [pa.array(x) for x in numbers[2:]]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, place bigint"
    schema += ", ids array<int>" if with_ids else ""
    names = [id, "piece", "start", "length", "ids_crc32", "part", "place", "ids"][: 7 + with_ids]
    return docs.select(F.col(id), F.col(text).alias(name)).mapInArrow(run, schema)


def reduced(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, dict[int, int]]:
    """Fix every set that provably dominates all sets with its largest piece; what remains is the smaller instance.

    For a piece s, with k the longest other piece that fits beside it:
    nothing fits: {s}; s + k fills the sequence: {s, k}; only one more piece can
    fit: {s, k}; at most two more can fit and no two are together longer than
    k: {s, k}; at most two more can fit and the best two, p and q, stand above
    every other pair and single piece: {s, p, q}.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    fixed: Plan = []

    def fix(*pattern: int) -> None:
        times = min(counts[s] // pattern.count(s) for s in set(pattern))
        fixed.append((pattern, times))
        for s in pattern:
            counts[s] -= times
        for s in set(pattern):
            if not counts[s]:
                del counts[s]

    changed = True
    while changed:
        changed = False
        for s in sorted(counts, reverse=True):
            while s in counts:
                found = _dominating(counts, s, capacity)
                if found is None:
                    break
                fix(*found)
                changed = True
    return fixed, counts


def _dominating(counts: dict[int, int], s: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - s
    # The other pieces that fit, shortest first; at most three of a length matter.
    fits = sorted(k for k in counts if k <= room and (k != s or counts[k] > 1))
    if not fits:
        return (s,)
    left = {k: counts[k] - (k == s) for k in fits}
    k = fits[-1]
    smallest = [x for x in fits[:3] for _ in range(min(3, left[x]))][:3]
    if k == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (s, k)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    best, pairs = (0, 0), []
    for p in fits:
        # The longest partner of p that fits, not longer than p.
        at = bisect.bisect_right(fits, min(room - p, p if left[p] > 1 else p - 1)) - 1
        if at >= 0:
            pairs.append((p, fits[at]))
            best = max(best, (p + fits[at], p))
    total, p = best
    q = total - p
    if k >= total:
        return (s, k)
    if p == k and all(d <= q or c + d <= p for c, d in pairs):
        return (s, p, q)
    return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first, on equal pieces at once: into the fullest open sequence with room."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def add(pattern: tuple[int, ...], times: int, room: int) -> None:
        if not times:
            return
        if room not in open_by_room:
            bisect.insort(rooms, room)
        open_by_room.setdefault(room, []).append([pattern, times])

    for s in sorted(counts, reverse=True):
        rest = counts[s]
        while rest:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, pattern, times = capacity, (), -(-rest // (capacity // s))
            # A sequence takes as many as fit before the next one is opened.
            each = min(room // s, rest)
            used = min(times, rest // each)
            add(pattern + (s,) * each, used, room - s * each)
            add(pattern, times - used, room) if pattern else None
            rest -= used * each
    return [(pattern, times) for groups in open_by_room.values() for pattern, times in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(chosen: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for each slot of each pattern."""
    taken: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in chosen:
        offset = 0
        for s in pattern:
            rank = taken.get(s, 0)
            out.append((s, rank, rank + times, sequence, offset))
            taken[s] = rank + times
            offset += s
        sequence += times
    return out


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of `pieces` with sequence_id and offset."""
    found = kept(found)
    spark = found.sparkSession
    counted = found.groupBy("part", "length").agg((F.max("place") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = kept(counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    # One row per length at most, so the plan does not grow with the data.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        places(plan(counts, capacity)), "length bigint, rank_from bigint, rank_to bigint, sequence bigint, offset bigint"
    )
    rows = found.join(counted.select("part", "length", "before"), ["part", "length"])
    rows = rows.withColumn("rank", F.col("place") + F.col("before"))
    slots = F.broadcast(slots.withColumnRenamed("length", "slot"))
    inside = (F.col("length") == F.col("slot")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return rows.join(slots, inside).withColumn(
        "sequence_id", F.col("sequence") + F.col("rank") - F.col("rank_from")
    ).drop("part", "place", "before", "rank", "slot", "rank_from", "rank_to", "sequence")


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces that carry ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
