"""Exact top-k search by inner product over a bit-sliced index.

The index holds rows in blocks. A block stores, for every attribute, its least
value and bitmaps of the binary digits (slices) above it, one bit per row. A
query weighs the slices by its own components, and all rows of a block are
scored at once by bitmap arithmetic: bitmaps of equal weight are added three to
two by carry-save adders, from the lightest weight up, which gives the slices
of the score. The lightest weights, all together at most 1/128 of the score's
range, are left out of the sum; that is the error of a score.

The slices of the score are read from the most significant one downward to find
the k-th largest sum, and with it, the error and what earlier blocks gave, the
sums that can still matter. The rows at or above that boundary are resolved
exactly from all their slices. So the answer is exact for any data; only the
number of rows to resolve depends on it.

Queries and index meet block by block: a task takes a block of queries and
`LANE` blocks of the index in turn and keeps k rows per query. All rows are
searched, and nothing is broadcast.

Defined cases. A vector that is NULL or holds a NULL, NaN or infinite component
takes no part, nor does a row without an id. Of rows that repeat an id the least
quantised vector counts. Missing components of shorter vectors count as 0; an
empty vector scores 0 with all. Ties go to the smaller id. Fewer rows than k
give fewer ranks, an empty table gives none. Quantised components must be below
2^53, scores must fit a long; both end in an error, not in wrong rows. Other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import kept
from signalmill.operators.ordered import first_per_key

# Components in a block of the index, and queries in a block.
CELLS = 1 << 21
QUERIES = 256
# Blocks of the index that one task goes through.
LANE = 64
# The error of a sum is at most its range / 2^PRECISION.
PRECISION = 7
# Rows resolved at once.
RESOLVED = 1 << 12


def quantised(rows: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """One row per id: id and v, the components x as floor(scale * x)."""
    numbers = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    numbers = numbers.filter(
        "id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    whole = f"""transform(v, x -> IF(abs({scale} * x) < 9007199254740992D, CAST(floor({scale} * x) AS BIGINT),
        raise_error('a quantised component is beyond 2^53')))"""
    return kept(numbers.selectExpr("id", f"{whole} AS v").groupBy("id").agg(F.min("v").alias("v")))


def _dealt(rows: DataFrame, size: int, seed: int, out: str) -> tuple[DataFrame, int]:
    """Rows with the number of their block of about `size` rows, and how many blocks there are."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn(out, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")), n


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix, short ones filled with 0."""
    lists = column.combine_chunks()
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def index(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """The bit-sliced index of quantised rows (id, v), one row per block: block, ids, low, bits, slices.

    Slices lie attribute by attribute, lightest digit first, each padded to whole words of 64 rows.
    """
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    dealt, _ = _dealt(rows, max(64, cells // max(1, widest)), 1, "block")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block int, ids array<{kind}>, low array<bigint>, bits array<int>, slices binary"

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        v = _matrix(rows.column("v"))
        low = v.min(axis=0)
        above = v - low
        bits = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int32)
        digits = [(above[:, j] >> b) & 1 for j in range(v.shape[1]) for b in range(bits[j])]
        packed = np.zeros((len(digits), -(-len(v) // 64) * 8), np.uint8)
        for place, digit in zip(packed, digits, strict=True):
            own = np.packbits(digit.astype(np.uint8), bitorder="little")
            place[: len(own)] = own
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), rows.column("id").combine_chunks()),
                "low": pa.array([low.tolist()], pa.list_(pa.int64())),
                "bits": pa.array([bits.tolist()], pa.list_(pa.int32())),
                "slices": pa.array([packed.tobytes()], pa.binary()),
            }
        )

    return kept(dealt.select("block", "id", "v").groupBy("block").applyInArrow(build, schema))


def _added(rows: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Bitmaps of one weight as their sum's bitmap at that weight, and the carries to the next."""
    carries = [rows[:0]]
    while len(rows) > 2:
        k = len(rows) // 3
        a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
        half = a ^ b
        carries.append((a & b) | (half & c))
        rows = np.concatenate((half ^ c, rows[3 * k :]))
    if len(rows) == 2:
        carries.append(rows[:1] & rows[1:])
        rows = rows[:1] ^ rows[1:]
    return (rows[0] if len(rows) else None), np.concatenate(carries)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class _Block:
    """A block of the index in a task."""

    def __init__(self, ids: list, low: list[int], bits: list[int], slices: bytes):
        self.ids, self.places = ids, {x: k for k, x in enumerate(ids)}
        self.low, widths = np.array(low, np.int64), np.array(bits, np.int64)
        self.widths, self.words = widths, -(-len(ids) // 64)
        self.attribute = np.repeat(np.arange(len(widths)), widths)
        self.digit = np.arange(len(self.attribute)) - np.repeat(np.cumsum(widths) - widths, widths)
        self.slices = np.frombuffer(slices, np.uint64).reshape(len(self.attribute), self.words)
        self.bytes = np.frombuffer(slices, np.uint8).reshape(len(self.attribute), 8 * self.words)
        self.all = np.zeros(8 * self.words, np.uint8)
        own = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.all[: len(own)] = own
        self.all = self.all.view(np.uint64)
        self.most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.low + 2.0**widths))

    def sums(self, query: np.ndarray) -> tuple[dict[int, np.ndarray], int, int, int]:
        """Slices of the sums by weight, the lightest weight kept, what to add to a sum, and its error."""
        size, minus = np.abs(query), query < 0
        # A negative component weighs the complement of its slices.
        base = int(query @ self.low) - sum(int(s) * ((1 << int(w)) - 1) for s, w in zip(size[minus], self.widths[minus], strict=True))
        own = size[self.attribute]
        flips = np.where(minus[self.attribute], ~np.uint64(0), np.uint64(0))
        which, weight = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s in range(int(size.max(initial=0)).bit_length()):
            some = np.flatnonzero((own >> s) & 1)
            which.append(some)
            weight.append(self.digit[some] + s)
        which, weight = np.concatenate(which), np.concatenate(weight)
        masses = [int(n) << w for w, n in enumerate(np.bincount(weight))]
        left, lightest, error = sum(masses) >> PRECISION, 0, 0
        while lightest < len(masses) and error + masses[lightest] <= left:
            error += masses[lightest]
            lightest += 1
        out, carries, at = {}, self.slices[:0], lightest
        while at < len(masses) or len(carries):
            own_rows = which[weight == at]
            rows = np.concatenate((self.slices[own_rows] ^ flips[own_rows, None], carries))
            total, carries = _added(rows)
            if total is not None:
                out[at] = total
            at += 1
        return out, lightest, base, error

    def boundary(self, sums: dict[int, np.ndarray], lightest: int, rows: np.ndarray, k: int) -> int:
        """The k-th largest sum among `rows`, which are k at least, most significant slice first."""
        sure, tied, found = np.zeros_like(rows), rows, 0
        for w in sorted(sums, reverse=True):
            with_one = tied & sums[w]
            if _count(sure) + _count(with_one) >= k:
                tied, found = with_one, found | 1 << w
            else:
                sure, tied = sure | with_one, tied & ~sums[w]
        return found

    def at_least(self, sums: dict[int, np.ndarray], lightest: int, rows: np.ndarray, least: int) -> np.ndarray:
        """The rows whose sum is `least` or more."""
        if least <= 0:
            return rows
        least = -(-least >> lightest) << lightest
        top = max(sums, default=-1)
        if least >> (top + 1):
            return np.zeros_like(rows)
        more, tied = np.zeros_like(rows), rows
        for w in range(top, lightest - 1, -1):
            own = sums.get(w)
            if least >> w & 1:
                tied = tied & own if own is not None else np.zeros_like(rows)
            elif own is not None:
                more, tied = more | (tied & own), tied & ~own
        return more | tied

    def scores(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, from all their slices."""
        weights = query[self.attribute] << self.digit
        out = []
        for first in range(0, len(places), RESOLVED):
            some = places[first : first + RESOLVED]
            digits = (self.bytes[:, some >> 3] >> (some & 7).astype(np.uint8)) & 1
            out.append(weights @ digits.astype(np.int64) + int(query @ self.low))
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def best(self, query_id: object, query: np.ndarray, k: int, known: list[tuple]) -> list[tuple]:
        """The k best (-score, id) of this block's rows and the `known` ones."""
        if float(np.abs(query.astype(float)) @ self.most) >= 2.0**62:
            raise OverflowError(f"scores of query {query_id} do not fit a long")
        rows = self.all
        if query_id in self.places:
            place = self.places[query_id]
            rows = rows.copy()
            rows[place // 64] &= ~(np.uint64(1) << np.uint64(place % 64))
        sums, lightest, base, error = self.sums(query)
        least = -known[k - 1][0] if len(known) >= k else None
        if _count(rows) >= k:
            here = base + self.boundary(sums, lightest, rows, k)
            least = here if least is None else max(least, here)
        if least is not None:
            rows = self.at_least(sums, lightest, rows, least - base - error)
        places = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        scores = self.scores(query, places)
        order = np.lexsort((places, -scores))[:k]
        return sorted([*known, *((-int(scores[o]), self.ids[places[o]]) for o in order)])[:k]


def nearest(
    indexed: DataFrame, queries: DataFrame, k: int, query_block: int = QUERIES, lane: int = LANE
) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best rows of the index for each query (id, v), without its own."""
    kind = indexed.schema["ids"].dataType.elementType.simpleString()
    dealt, parts = _dealt(queries, query_block, 2, "part")
    packed = dealt.groupBy("part").agg(F.collect_list("id").alias("query_ids"), F.collect_list("v").alias("vectors"))
    lanes = -(-((indexed.agg(F.max("block")).first()[0] or 0) + 1) // lane)
    asked = packed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    blocks = indexed.withColumn("lane", F.expr(f"CAST(block div {lane} AS INT)")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    met = blocks.join(asked.hint("merge"), ["lane", "part"])
    schema = f"query_id {kind}, id {kind}, score bigint"

    def told(best: dict, ids: pa.DataType) -> pa.RecordBatch:
        rows = [(q, i, -s) for q, found in best.items() for s, i in found]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (ids, ids, pa.int64()), strict=True)], names=["query_id", "id", "score"]
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best, kind = None, {}, pa.null()
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                own = (one.column("lane")[0].as_py(), one.column("part")[0].as_py())
                if own != task:
                    if best:
                        yield told(best, kind)
                    task, best = own, {}
                kind = one.schema.field("ids").type.value_type
                block = _Block(*(one.column(c)[0].as_py() for c in ("ids", "low", "bits", "slices")))
                ids = one.column("query_ids")[0].as_py()
                vectors = _matrix(pa.chunked_array([one.column("vectors").combine_chunks().flatten()]), len(block.low))
                for query_id, vector in zip(ids, vectors[:, : len(block.low)], strict=True):
                    best[query_id] = block.best(query_id, vector, k, best.get(query_id, []))
        if best:
            yield told(best, kind)

    found = met.select("lane", "part", "ids", "low", "bits", "slices", "query_ids", "vectors").mapInArrow(search, schema)
    ranked = first_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
    return ranked.select("query_id", F.col("_rank").alias("rank"), "id", "score")

