"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Two lines match if the Jaccard similarity of
their sets is 0.8 or more, and a line goes if an earlier line matches it, in
the order of (document id, line number) over the whole corpus.

1. Words are counted in a table of fixed size by their hash; the counts order
   the words of a line from rare to frequent. Any order gives the exact result,
   so words that share a place in the table only cost time.
2. Lines with the same set become one, with their first place.
3. A set of n words is listed under its first n - ceil(0.8 n) + 1 words; sets
   that match share one of them. Two sets that meet under a word are dropped by
   the length filter, by the positional filter (how many words can still be
   common before and after this one) and by the symmetric difference of their
   bitmaps, which bounds the overlap from above. What is left goes on as a
   spanning star per word, so no word yields more rows than it lists.
4. The components of the stars are clusters. A cluster gathers the words of its
   lines from the texts and verifies the Jaccard similarity of every pair that
   passes the filters. Only sets with an earlier match leave the task.

Words and clusters with many sets are dealt into blocks, and each pair of
blocks is a group of its own. All filters bound from the safe side: no match is
lost, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import WORD_TABLE, kept, pieces_of
from signalmill.llm.jaccard_join import mixed
from signalmill.operators.graph import components, stars
from signalmill.operators.pairing import (
    PAIRS,
    deal_out,
    groups_of,
    roots,
    row_pairs,
    shared_counts,
    sort_by_group,
    starts_of,
)

THRESHOLD = 0.8
# Places of the table of word counts, and how many of them travel in one row.
TABLE = 1 << 22
CHUNK = 1 << 16
# Words with a number of blocks of their own. With N listings, no more than HOT words have more than N / HOT of them.
HOT = 1 << 20
# Bits of a filter: 16 for each of its members, at least and at most so many, and how many travel in one row.
LEAST_FILTER = 1 << 20
MOST_FILTER = 1 << 29
FILTER_CHUNK = 1 << 19
BLOCK = 400
# Listings that a task packs at once.
ROWS_AT_ONCE = 1 << 18
# Listings of a bucket of words. From MANY buckets on they grow instead of their number, up to LARGE_BUCKET listings.
BUCKET = 1 << 13
MANY = 1 << 12
LARGE_BUCKET = 1 << 17
# Clusters of up to this many sets are verified together, pair by pair, so many words at a time.
FEW = 16
WORDS_AT_ONCE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Bits of the bitmap of every set, and of the second one of sets with more than LONG words.
BITS = 128
LONG_BITS = 512
LONG = 128
# Words of up to this many bytes are hashed in vectorised steps of eight bytes.
SHORT_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEEDS = np.array([0x2545F4914F6CDD1D, 0xD1B54A32D192ED03], np.uint64)


def least_overlap(sizes, threshold: float):
    """Fewest common words of two sets whose sizes add up to `sizes`."""
    return np.ceil(threshold / (1 + threshold) * sizes - 1e-9)


def prefix_length(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


# --- words and sets of lines ----------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= np.uint64(factor)
        x ^= x >> np.uint64(33)
    return x


def word_hashes(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at `begin`; `text` has eight more bytes than its words reach."""
    lanes = np.ndarray(len(text) - 7, np.uint64, text, strides=(1,))
    out = length.astype(np.uint64) * _STEP
    live = slice(None)
    for at in range(0, SHORT_WORD, 8):
        left = length[live] - at
        lane = lanes[begin[live] + at] & _MASKS[np.minimum(left, 8)]
        out[live] = _spread(out[live] ^ lane)
        more = np.flatnonzero(left > 8)
        live = more if at == 0 else live[more]
        if not len(live):
            break
    for k in live:
        out[k] = xxhash.xxh64_intdigest(text[begin[k] : begin[k] + length[k]].tobytes())
    return out


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts of a string column, and the text and the line, counted from 0, of each word."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets[:-1] - offsets[0]
    text = np.frombuffer(raw.tobytes().translate(WORD_TABLE) + b" " * 8, np.uint8)
    inside = text[: len(raw)] != 0x20
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    # A text starts and ends words, too.
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    begin[edges], end[edges - 1] = inside[edges], inside[edges - 1]
    begin = np.flatnonzero(begin)
    length = np.flatnonzero(end) - begin + 1
    breaks = np.flatnonzero(raw == 0x0A)
    # Texts and line feeds are far fewer than words, so they are looked up among the words.
    of = np.repeat(np.arange(len(bounds)), np.diff(np.searchsorted(begin, bounds), append=len(begin)))
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(begin, breaks), prepend=0, append=len(begin)))
    return word_hashes(text, begin, length), of, line - np.searchsorted(breaks, bounds)[of]


@dataclass
class LineSets:
    """The word sets of all lines that have words: `words` of set k are starts[k] to starts[k + 1]."""

    words: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    line: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def digests(self) -> np.ndarray:
        """Two 64-bit numbers per set, sums over its words, whatever their order."""
        if not len(self.words):
            return np.zeros((0, 2), np.uint64)
        return np.stack([np.add.reduceat(_spread(self.words ^ seed), self.starts[:-1]) for seed in _SEEDS], axis=1)


def line_sets(column: pa.Array, rare: np.ndarray | None = None) -> LineSets:
    """The sets of the lines of some texts; words go from rare to frequent, by `rare`, and by hash."""
    own, text, line = text_words(column)
    changed = np.ones(len(own), bool)
    changed[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    first, row = np.flatnonzero(changed), np.cumsum(changed) - 1
    order = _ordered(own, row, np.zeros(len(own), np.uint8) if rare is None else rare[own & np.uint64(TABLE - 1)])
    own, at = own[order], row[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
    own, at = own[fresh], at[fresh]
    return LineSets(own, np.searchsorted(at, np.arange(len(first) + 1)), text[first], line[first])


def _ordered(own: np.ndarray, row: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The order by row, rarity and hash."""
    if len(row) and row[-1] < 1 << 24:
        # One number per word is sorted faster than three; it has the upper half of the hash.
        key = row.astype(np.uint64) << np.uint64(40) | rare.astype(np.uint64) << np.uint64(32) | own >> np.uint64(32)
        order = np.argsort(key)
        key, sorted_own = key[order], own[order]
        if not ((key[1:] == key[:-1]) & (sorted_own[1:] != sorted_own[:-1])).any():
            return order
    return np.lexsort((own, rare, row))


def binary(values: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array of numbers as binary values."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


# --- word counts ----------------------------------------------------------------


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, places, counts in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            own = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
            own[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int64)
    yield _chunks(total)


def _chunks(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    some = {k: np.flatnonzero(v) for k, v in total.items()}
    return pa.RecordBatch.from_pydict(
        {
            "chunk": pa.array(total, pa.int32()),
            "places": pa.array([some[k].astype(np.uint16).tobytes() for k in total], pa.binary()),
            "counts": pa.array([total[k][some[k]].tobytes() for k in total], pa.binary()),
            "salt": pa.array([0] * len(total), pa.int32()),
        }
    )


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How frequent the words of each place of the table are: 0 to 255, on a log scale. TABLE bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(TABLE, np.int64), [], 0
        for piece in pieces_of(batches, text):
            waiting.append((text_words(piece.column(0))[0] & np.uint64(TABLE - 1)).astype(np.int64))
            held += len(waiting[-1])
            if held >= TABLE // 2:
                total += np.bincount(np.concatenate(waiting), minlength=TABLE)
                waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=TABLE)
        yield _chunks({k: part for k, part in enumerate(total.reshape(-1, CHUNK)) if part.any()})

    return np.minimum(255, 8 * np.log2(1.0 + _collected(docs.select(F.col(text)).mapInArrow(count, _CHUNK)))).astype(np.uint8)


_CHUNK = "chunk int, places binary, counts binary, salt int"


def _collected(rows: DataFrame) -> np.ndarray:
    """The table of counts that tasks handed on in chunks: TABLE numbers, whatever the data."""
    salted = rows.withColumn("salt", F.spark_partition_id() % 32)
    once = salted.repartition("chunk", "salt").mapInArrow(_summed, _CHUNK)
    out = np.zeros(TABLE, np.int64)
    for row in once.repartition("chunk").mapInArrow(_summed, _CHUNK).collect():
        at = np.frombuffer(row["places"], np.uint16).astype(np.int64) + row["chunk"] * CHUNK
        out[at] = np.frombuffer(row["counts"], np.int64)
    return out


# --- sets of lines --------------------------------------------------------------


def bitmap_rows(own: np.ndarray, starts: np.ndarray, size: int = BITS) -> np.ndarray:
    """The bitmaps of some sets, as rows of 64-bit numbers."""
    at = ((own >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)
    marks = np.zeros((len(starts) - 1, size), bool)
    marks[np.repeat(np.arange(len(marks)), np.diff(starts)), at] = True
    return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)


def bitmaps(own: np.ndarray) -> tuple[bytes, bytes | None]:
    bits, _, longer = set_bitmaps(own, np.array([0, len(own)]))
    return bits.tobytes(), longer.tobytes() or None


def set_bitmaps(own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bitmaps of some sets, which of the sets are long, and the larger bitmaps of these."""
    sizes = np.diff(starts)
    long = sizes > LONG
    longer = bitmap_rows(own[np.repeat(long, sizes)], np.concatenate(([0], np.cumsum(sizes[long]))), LONG_BITS)
    return bitmap_rows(own, starts), long, longer


_BITS = [f"bits{k}" for k in range(BITS // 64)]
_PLACED = "id bigint, text_hash bigint, line int, digest binary"


def _hashed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def _placed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, text_hash, text of the rows that take part."""
    return _hashed(docs.filter(F.col(id).isNotNull()), id, text)


def _sets(docs: DataFrame, id: str, text: str, threshold: float) -> DataFrame:
    """One row per different set: node, digest, first place, number of lines, size, prefix words, bitmaps."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for piece in pieces_of(batches, "text"):
            sets = line_sets(piece.column(2), rare)
            lengths = prefix_length(sets.sizes, threshold)
            place = np.arange(len(sets.words)) - np.repeat(sets.starts[:-1], sets.sizes)
            listed = (sets.words[place < np.repeat(lengths, sets.sizes)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            bits, long, longer = set_bitmaps(sets.words, sets.starts)
            more = np.full(len(long), None, object)
            more[long] = [row.tobytes() for row in longer]
            where = pa.array(sets.text)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(where),
                    piece.column(1).take(where),
                    pa.array(sets.line.astype(np.int32)),
                    binary(sets.digests()),
                    pa.array(sets.sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array(listed)),
                    *[pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(BITS // 64)],
                    pa.array(more, pa.binary()),
                ],
                names=["id", "text_hash", "line", "digest", "size", "prefix", *_BITS, "more"],
            )

    schema = f"{_PLACED}, size int, prefix array<int>, {', '.join(f'{c} bigint' for c in _BITS)}, more binary"
    found = _placed(docs, id, text).mapInArrow(run, schema)
    first = F.min(F.struct("id", "text_hash", "line", "size", "prefix", *_BITS, "more")).alias("first")
    sets = found.groupBy("digest").agg(first, F.count("*").alias("times")).select("digest", "first.*", "times")
    return sets.withColumn("node", F.monotonically_increasing_id())


# --- candidates -----------------------------------------------------------------


class Bitmaps:
    """Bitmaps of some sets, and the larger ones of long sets."""

    def __init__(self, bits: list[bytes], more: list[bytes | None]):
        self._set(
            np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64),
            np.array([x is not None for x in more], bool),
            np.frombuffer(b"".join(x for x in more if x is not None), np.uint64).reshape(-1, LONG_BITS // 64),
        )

    def _set(self, bits: np.ndarray, long: np.ndarray, longer: np.ndarray) -> Bitmaps:
        self.bits, self.has, self.more = bits, long, longer
        self.place = np.cumsum(long) - 1
        return self

    @classmethod
    def of(cls, bits: np.ndarray, long: np.ndarray, longer: np.ndarray) -> Bitmaps:
        """From what `set_bitmaps` returns."""
        return cls.__new__(cls)._set(bits, long, longer)

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fewest words in which the sets of each pair differ."""
        out = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)
        both = np.flatnonzero(self.has[a] & self.has[b])
        if len(both):
            x, y = self.more[self.place[a[both]]], self.more[self.place[b[both]]]
            out[both] = np.maximum(out[both], np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64))
        return out


def able_pairs(
    a: np.ndarray, b: np.ndarray, sizes: np.ndarray, at: np.ndarray | None, bits: Bitmaps, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that pass the length filter, the positional filter (with places `at`) and the bitmaps."""
    x, y = sizes[a], sizes[b]
    able = np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9
    if at is not None:
        most = np.minimum(at[a], at[b]) + np.minimum(x - at[a], y - at[b])
        able &= most >= least_overlap(x + y, threshold)
    a, b = a[able], b[able]
    # |A| + |B| = 2 |A and B| + |A xor B|, and the bitmaps differ in no more places than the sets.
    total = sizes[a] + sizes[b]
    able = (total - bits.differences(a, b)) // 2 >= least_overlap(total, threshold)
    return a[able], b[able]


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The prefix words of some sets, and their rows."""
    prefix = batch.column(batch.schema.get_field_index("prefix"))
    lengths = np.asarray(prefix.value_lengths().fill_null(0))
    return prefix.flatten().to_numpy().view(np.uint32).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def _listings(sets: DataFrame) -> np.ndarray:
    """How many sets are listed under the words of each place of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for batch in batches:
            total += np.bincount(_places(batch)[0] & (TABLE - 1), minlength=TABLE)
        yield _chunks({k: part for k, part in enumerate(total.reshape(-1, CHUNK)) if part.any()})

    return _collected(sets.select("prefix").mapInArrow(count, _CHUNK))


# A listing: `meta` packs size, place in the prefix, side, and whether both blocks are the same.
_RECORD = np.dtype([("key", np.uint64), ("node", np.int64), ("meta", np.int64), ("bits", np.uint64, BITS // 64)])
_LISTED = "bucket int, listings binary, more binary"


def _long(records: np.ndarray) -> np.ndarray:
    return records["meta"] >> 33 > LONG


def _packed(records: np.ndarray, longer: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket of keys: its listings, and the larger bitmaps of those of long sets, in the same order."""
    bucket = (records["key"] % np.uint64(buckets)).astype(np.int32)
    place = np.cumsum(_long(records)) - 1
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    long = _long(records)
    longer = longer[place[order[long]]]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
    ends = np.concatenate((starts, [len(bucket)]))
    before = np.concatenate(([0], np.cumsum(long)))

    def cut(values: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])

    columns = [pa.array(bucket[starts]), cut(records, ends, _RECORD.itemsize), cut(longer, before[ends], LONG_BITS // 8)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "listings", "more"])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, Bitmaps]:
    """The listings of a bucket and their bitmaps, sorted by key and `meta`."""
    records = np.frombuffer(b"".join(rows.column("listings").to_pylist()), _RECORD)
    longer = np.frombuffer(b"".join(rows.column("more").to_pylist()), np.uint64).reshape(-1, LONG_BITS // 64)
    place = np.cumsum(_long(records)) - 1
    order = np.lexsort((records["meta"], records["key"]))
    records = records[order]
    long = _long(records)
    return records, Bitmaps.of(np.ascontiguousarray(records["bits"]), long, longer[place[order[long]]])


def _meeting(key: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs with the same key that pass the length filter, some at a time; rows are sorted by key and size."""
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(np.int64)
    largest = np.minimum(np.floor(sizes / threshold + 1e-9).astype(np.int64), (1 << 31) - 1)
    # The rows from the next one up to `end` have the same key and are small enough.
    end = np.searchsorted(group << 31 | sizes, group << 31 | largest, "right")
    partners = end - np.arange(len(key)) - 1
    total = np.cumsum(partners)
    first = 0
    while first < len(key):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        a = np.repeat(np.arange(first, last), partners[first:last])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[first:last] - partners[first:last] - done, partners[first:last])
        if len(a):
            yield a, b
        first = last


def _hot_words(sets: DataFrame, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The words with more than `block` listings, in order, and their numbers of blocks; counted by word.

    Only words at places of the table with that many listings can be hot.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts > block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able = shared.value
        for batch in batches:
            own = _places(batch)[0]
            word, times = np.unique(own[able[own & (TABLE - 1)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(times)], names=["word", "times"])

    found = sets.select("prefix").mapInArrow(count, "word bigint, times bigint")
    hot = found.groupBy("word").agg(F.sum("times").alias("times")).filter(F.col("times") > block).toArrow()
    word, times = hot.column("word").to_numpy(), hot.column("times").to_numpy()
    order = np.argsort(word)
    return word[order], -(-times[order] // block)


def _star(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each of `n` rows but the first of its component, and that first row."""
    root = roots(n, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True))) if pairs else np.arange(n)
    other = np.flatnonzero(root != np.arange(n))
    return other, root[other]


def _candidates(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): edges that connect the pairs of sets that meet under a word and pass the filters.

    Listings travel packed, a row per task and bucket of keys; a bucket has some
    thousand listings, so their number follows the data. A task contracts the
    edges of all its words to the smallest set.
    """
    counts = _listings(sets)
    # So there are no more than HOT hot words, and any other word has a group of this size at most.
    block = max(block, -(-int(counts.sum()) // HOT))
    hot, hot_blocks = _hot_words(sets, counts, block)
    # Every listing of a word goes to each of its blocks.
    total = int(counts.sum() + block * (hot_blocks * (hot_blocks - 1)).sum())
    buckets = max(1, -(-total // BUCKET) if total < MANY * BUCKET else max(MANY, -(-total // LARGE_BUCKET)))
    shared = sets.sparkSession.sparkContext.broadcast((counts > 1, hot, hot_blocks))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, hot, hot_blocks = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            words_of, row = _places(batch)
            node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            at = np.arange(len(row)) - np.searchsorted(row, row)
            blocks = several[words_of & (TABLE - 1)].astype(np.int64)
            if len(hot):
                near = np.minimum(np.searchsorted(hot, words_of), len(hot) - 1)
                blocks = np.where(hot[near] == words_of, hot_blocks[near], blocks)
            # One listing per block that the own block is compared with; none for a word alone.
            source = np.repeat(np.arange(len(row)), blocks)
            other = np.arange(len(source)) - np.searchsorted(source, source)
            word, of = words_of[source].astype(np.uint64), row[source]
            own = (mixed(node[of].astype(np.uint64) * _STEP + word) % blocks[source].astype(np.uint64)).astype(np.int64)
            first, second = np.minimum(own, other), np.maximum(own, other)
            key = mixed(mixed(word * _STEP + first.astype(np.uint64)) + second.astype(np.uint64) * _STEP)
            meta = size[of] << 33 | at[source] << 2 | (own > other).astype(np.int64) << 1 | (first == second)
            bits = np.stack([batch.column(3 + k).to_numpy().view(np.uint64) for k in range(len(_BITS))], axis=1)
            more = batch.column(3 + len(_BITS))
            longer = np.frombuffer(b"".join(more.drop_null().to_pylist()), np.uint64).reshape(-1, LONG_BITS // 64)
            place = np.cumsum(size > LONG) - 1
            for begin in range(0, len(of), ROWS_AT_ONCE):
                part = of[begin : begin + ROWS_AT_ONCE]
                records = np.empty(len(part), _RECORD)
                records["key"], records["meta"] = key[begin : begin + len(part)], meta[begin : begin + len(part)]
                records["node"], records["bits"] = node[part], bits[part]
                held.append((records, longer[place[part[size[part] > LONG]]]))
                if sum(len(x) for x, _ in held) >= ROWS_AT_ONCE:
                    yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                    held = []
        if held:
            yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for many in groups_of(batches, ["bucket"]):
            starts = [*starts_of(many, ["bucket"]), many.num_rows]
            for first, end in zip(starts, starts[1:], strict=False):
                records, bits = _unpacked(many.slice(first, end - first))
                node, meta = np.ascontiguousarray(records["node"]), np.ascontiguousarray(records["meta"])
                sizes, at, sides, same = meta >> 33, (meta >> 2) & 0x7FFFFFFF, (meta >> 1) & 1, meta & 1
                left: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b in _meeting(np.ascontiguousarray(records["key"]), sizes, threshold):
                    able = (same[a] == 1) | (sides[a] != sides[b])
                    left.append(able_pairs(a[able], b[able], sizes, at, bits, threshold))
                    if sum(len(a) for a, _ in left) > PAIRS:
                        left = [_star(len(node), left)]
                a, b = _star(len(node), left)
                yield node[a], node[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in stars(edges(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # Sizes are the upper part of `meta`. The number of blocks of a word is known from the table, so one shuffle is enough.
    rows = sets.select("node", "size", "prefix", *_BITS, "more").mapInArrow(listed, _LISTED)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint").distinct()


# --- verification ---------------------------------------------------------------


def filter_places(keys: np.ndarray, size: int) -> np.ndarray:
    """Two places of a filter per pair of keys."""
    return (keys & np.uint64(size - 1)).astype(np.int64)


def passes(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which pairs of keys pass a filter: all members, and one in sixty of the others until it has its full size."""
    own = np.frombuffer(bits, np.uint8)
    at = filter_places(keys, 8 * len(own))
    return (own[at >> 3] >> (at & 7) & 1).all(axis=1)


def filter_of(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> bytes:
    """The filter of all rows; its size follows their number, up to MOST_FILTER bits."""
    size = min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * rows.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(filter_places(keys(batch), size))
            chunks, starts = np.unique(at // FILTER_CHUNK, return_index=True)
            own = [x.astype(np.uint32).tobytes() for x in np.split(at % FILTER_CHUNK, starts[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(own, pa.binary())], names=["chunk", "own"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.frombuffer(own, np.uint32)
                part = parts.setdefault(chunk, np.zeros(FILTER_CHUNK // 8, np.uint8))
                np.bitwise_or.at(part, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for chunk, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "own"])

    schema = "chunk bigint, own binary"
    out = bytearray(size // 8)
    for row in rows.mapInArrow(mark, schema).repartition("chunk").mapInArrow(pack, schema).collect():
        at = row["chunk"] * FILTER_CHUNK // 8
        out[at : at + FILTER_CHUNK // 8] = row["own"]
    return bytes(out)


def place_keys(id: np.ndarray, text_hash: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Two keys per line, from its place."""
    x = _spread(id.astype(np.int64).view(np.uint64)) + text_hash.view(np.uint64)
    x = _spread(x) + line.astype(np.uint64) * _STEP
    return np.stack([_spread(x ^ seed) for seed in _SEEDS], axis=1)


def digest_keys(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)


def text_lines(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts, and of each line its text, its number from 0, its start and its end."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
    bounds = offsets - offsets[0]
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A)
    of = np.concatenate((np.arange(len(column)), np.searchsorted(bounds[:-1], breaks, "right") - 1))
    begin = np.concatenate((bounds[:-1], breaks + 1))
    order = np.lexsort((begin, of))
    of, begin = of[order], begin[order]
    end = bounds[1:][of]
    inner = np.flatnonzero(of[1:] == of[:-1])
    end[inner] = begin[inner + 1] - 1
    return raw, of, np.arange(len(of)) - np.searchsorted(of, of), begin, end


def _matched(
    docs: DataFrame, nodes: DataFrame, id: str, text: str, threshold: float, block: int
) -> DataFrame:
    """Digests of the sets that an earlier line matches."""
    firsts = nodes.select("id", "text_hash", "line")
    shared = docs.sparkSession.sparkContext.broadcast(
        filter_of(firsts, lambda batch: place_keys(*(c.to_numpy() for c in batch.columns)))
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text"):
            # Only lines that are the first place of a set of a cluster are cut into words.
            raw, of, line, begin, end = text_lines(piece.column(2))
            id, text_hash = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            found = np.flatnonzero(passes(shared.value, place_keys(id[of], text_hash[of], line)))
            sets = line_sets(pa.array([raw[begin[k] : end[k]] for k in found], pa.binary()).cast(pa.string()))
            found = found[sets.text]
            where = pa.array(of[found])
            own = [sets.words[at:to].tobytes() for at, to in zip(sets.starts, sets.starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(where), piece.column(1).take(where), pa.array(line[found].astype(np.int32)), binary(sets.digests()), pa.array(own, pa.binary())],
                names=["id", "text_hash", "line", "digest", "words"],
            )

    lines = _placed(docs, id, text).mapInArrow(gather, _PLACED + ", words binary")
    # Only the first place of a set counts.
    place = ["id", "text_hash", "line"]
    lines = lines.join(nodes, ["digest", *place], "inner").dropDuplicates(["digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in groups_of(batches, ["cluster", "first", "second"]):
            starts = np.array([*starts_of(many, ["cluster", "first", "second"]), many.num_rows])
            sizes = np.diff(starts)
            small = many.take(pa.array(np.flatnonzero(np.repeat(sizes <= FEW, sizes))))
            found = [small.column("digest").take(pa.array(_later_in_few(small, sizes[sizes <= FEW], threshold)))]
            for k in np.flatnonzero(sizes > FEW):
                group = many.slice(starts[k], sizes[k])
                found.append(group.column("digest").take(pa.array(_later(group, threshold))))
            for digest in found:
                yield from pa.table({"digest": digest}).to_batches()

    dealt = sort_by_group(deal_out(lines, "cluster", "digest", block), "cluster")
    return dealt.mapInArrow(run, "digest binary").distinct()


def _ranks(rows: pa.Table) -> np.ndarray:
    """The place of each row in the order of the lines."""
    place = np.lexsort([rows.column(k).to_numpy() for k in ("line", "text_hash", "id")])
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    return rank


def common_words(words: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the sets of each pair share."""
    out = np.zeros(len(a), np.int64)
    total = np.cumsum(np.diff(starts)[a] + np.diff(starts)[b])
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + WORDS_AT_ONCE, "right")))
        of = np.concatenate((a[first:last], b[first:last]))
        lengths = starts[of + 1] - starts[of]
        at = np.repeat(starts[of] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        pair, own = np.repeat(np.tile(np.arange(first, last), 2), lengths), words[at]
        order = np.lexsort((own, pair))
        pair, own = pair[order], own[order]
        # A set has a word once, so the same word twice in a pair is common.
        out += np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (own[1:] == own[:-1])], minlength=len(a))
        first = last
    return out


def _later_in_few(rows: pa.Table, members: np.ndarray, threshold: float) -> np.ndarray:
    """Rows that match an earlier line of their group, for many groups of a few rows each, one after the other."""
    own = rows.column("words").to_pylist()
    sizes = np.array([len(x) // 8 for x in own], np.int64)
    words, starts = np.frombuffer(b"".join(own), np.uint64), np.concatenate(([0], np.cumsum(sizes)))
    partners = np.repeat(np.cumsum(members), members) - np.arange(len(own)) - 1
    a = np.repeat(np.arange(len(own)), partners)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners) - partners, partners)
    side, same = rows.column("side").to_numpy(), rows.column("first").to_numpy() == rows.column("second").to_numpy()
    meet = same[a] | (side[a] != side[b])
    a, b = able_pairs(a[meet], b[meet], sizes, None, Bitmaps.of(*set_bitmaps(words, starts)), threshold)
    both, rank = common_words(words, starts, a, b), _ranks(rows)
    true = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    a, b = a[true], b[true]
    return np.unique(np.where(rank[a] > rank[b], a, b))


def _later(group: pa.Table, threshold: float) -> np.ndarray:
    """Rows of a group that match an earlier line of the group."""
    sets = [np.frombuffer(x, np.uint64) for x in group.column("words").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    rank = _ranks(group)
    bits = Bitmaps.of(*set_bitmaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))))
    common = shared_counts(sets)
    out = [np.zeros(0, np.int64)]
    same = group.column("first")[0].equals(group.column("second")[0])
    for a, b in row_pairs(group.column("side").to_numpy(), same):
        a, b = able_pairs(a, b, sizes, None, bits, threshold)
        both = common[a, b].astype(np.int64)
        true = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
        a, b = a[true], b[true]
        out.append(np.unique(np.where(rank[a] > rank[b], a, b)))
    return np.unique(np.concatenate(out))


# --- results --------------------------------------------------------------------


def _removed(docs: DataFrame, id: str, text: str, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n_lines) of all rows, and (id, text_hash, lines): the lines, counted from 0, that go from each document that loses any."""
    sets = kept(_sets(docs, id, text, threshold))
    near = components(_candidates(sets, threshold, block))
    sized = near.groupBy("component").agg(F.count("*").alias("members"))
    nodes = near.join(sized, "component").select(F.col("id").alias("node"), F.col("component").alias("cluster"), "members")
    nodes = kept(nodes.join(sets.select("node", "digest", "id", "text_hash", "line"), "node").drop("node"))
    matched = kept(_matched(docs, nodes, id, text, threshold, block))
    told = sets.join(matched.withColumn("matched", F.lit(True)), "digest", "left").filter("matched OR times > 1")
    told = kept(
        told.select(
            "digest", F.struct("id", "text_hash", "line").alias("first"), F.coalesce("matched", F.lit(False)).alias("matched")
        )
    )
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(told.select("digest"), lambda batch: digest_keys(batch.column(0))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text"):
            sets = line_sets(piece.column(2))
            digests = sets.digests()
            # Lines whose set occurs once and matches none stay in their task.
            found = np.flatnonzero(passes(shared.value, digests))
            held = np.searchsorted(sets.text[found], np.arange(piece.num_rows + 1)).astype(np.int32)
            own = pa.StructArray.from_arrays([pa.array(sets.line[found].astype(np.int32)), binary(digests[found])], ["line", "digest"])
            n_lines = pc.add(pc.fill_null(pc.count_substring(piece.column(2), "\n"), 0).cast(pa.int64()), 1)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), n_lines, pa.ListArray.from_arrays(pa.array(held), own)],
                names=["id", "text_hash", "n_lines", "own"],
            )

    schema = "id bigint, text_hash bigint, n_lines bigint, own array<struct<line: int, digest: binary>>"
    # Every text is read and cut once for its lines and their number.
    rows = kept(_hashed(docs, id, text).mapInArrow(places, schema))
    lines = rows.filter("id IS NOT NULL").select("id", "text_hash", F.inline("own"))
    gone = lines.join(told, "digest").filter(F.col("matched") | (F.struct("id", "text_hash", "line") != F.col("first")))
    # As many as the document has lines.
    return rows.drop("own"), gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def removed_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """Per document: id, n_lines, and `lines`, the numbers of the lines that go, counted from 0.

    Lines end at a line feed. Lines without words match nothing and stay. Rows
    that repeat id and text are one document, so they lose the same lines; a row
    without an id takes no part. Ids are integers. A NULL text is one empty line.
    """
    rows, gone = _removed(docs, id, text, threshold, block)
    gone = gone.withColumnRenamed("id", "_gone").withColumnRenamed("text_hash", "_hash")
    told = rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<int>")
    return told.select(F.col("id").alias(id), "n_lines", F.coalesce("lines", none).alias("lines"))


def without_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """All documents with all their columns; `text` has lost the lines that go. A NULL text stays."""
    _, gone = _removed(docs, id, text, threshold, block)
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"))
    gone = gone.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lines").alias("_gone"))
    joined = rows.join(gone, ["_id", "_hash"], "left").select("row", F.col(f"row.{text}").alias("text"), "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                drop = set(lines or ())
                out.append(whole if not drop else "\n".join(x for k, x in enumerate(whole.split("\n")) if k not in drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    done = joined.mapInArrow(run, joined.select("row", "text").schema)
    return done.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
