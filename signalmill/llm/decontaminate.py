"""Benchmark decontamination by a broadcast set of n-gram hashes.

The windows of the benchmark items, `n` consecutive words each, become a hash
set that every task holds. A task turns the words of a text into numbers (0 for
a word that no item has), looks only at stretches of known words that are long
enough, hashes all their windows at once, and verifies each hit word by word.

The set is broadcast in blocks of at most `BLOCK_WORDS` item words; their sizes
are counted before, equal rows once, and long items are cut. A benchmark of several blocks is scanned block by block: the
hit marks travel with the rows, which are written between the passes, so a task
never holds more than one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import WORD_TABLE, kept, words

N = 13
BLOCK_WORDS = 2_000_000
# A document is contaminated if at least one word in twenty is hit.
SHARE = 20
_SEED = np.random.default_rng(20_231).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` numbers."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for i in range(size):
        out += mixed[i : len(ids) - size + 1 + i] * _SEED[i]
        out ^= out >> np.uint64(31)
    return out


# Word numbers, sorted window hashes by window length, owners by window.
Index = tuple[dict[bytes, int], dict[int, np.ndarray], dict[bytes, set]]


def index_of(items: list[tuple[str | None, str | None]], n: int = N) -> Index:
    """The windows of (item, text) rows. An item of fewer than `n` words is one window."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[bytes, set] = {}
    found: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.uint32)
        if not len(numbers):
            continue
        size = min(n, len(numbers))
        found.setdefault(size, []).append(_hashes(numbers, size))
        for at in range(len(numbers) - size + 1):
            owner = owners.setdefault(numbers[at : at + size].tobytes(), set())
            if item is not None:
                owner.add(item)
    return vocabulary, {size: np.unique(np.concatenate(h)) for size, h in found.items()}, owners


def hits(listed: list[bytes], index: Index) -> tuple[np.ndarray | None, set]:
    """Marks of the words inside a window (None: there is no hit), and the items of these windows."""
    vocabulary, by_size, owners = index
    numbers = np.fromiter(map(vocabulary.get, listed, repeat(0)), np.uint32, len(listed))
    gaps = np.concatenate(([0], np.cumsum(numbers == 0)))
    marks, items = None, set()
    for size, hashes in by_size.items():
        if len(numbers) < size:
            continue
        # Positions whose next `size` words are all known.
        starts = np.flatnonzero(gaps[size:] == gaps[:-size])
        if not len(starts):
            continue
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            inside = _hashes(numbers[part[0] : part[-1] + size], size)
            where = np.minimum(np.searchsorted(hashes, inside), len(hashes) - 1)
            for at in part[hashes[where] == inside]:
                owner = owners.get(numbers[at : at + size].tobytes())
                if owner is not None:
                    marks = np.zeros(len(numbers), bool) if marks is None else marks
                    marks[at : at + size] = True
                    items |= owner
    return marks, items


def _blocks(benchmark: DataFrame, item: str, text: str, n: int, block_words: int) -> list[DataFrame]:
    """The different items in parts of at most `block_words` words, long ones in stretches that overlap by n - 1 words."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    most = max(n, block_words // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = words(whole)
                starts = range(0, len(listed) - n + 1, most - n + 1) if len(listed) > most else [0] if listed else []
                parts = [listed[at : at + most] for at in starts]
                if parts:
                    columns = [[name] * len(parts), [b" ".join(x).decode() for x in parts], list(map(len, parts))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["item", "text", "size"])

    parts = rows.mapInArrow(run, "item string, text string, size bigint").distinct()
    total = parts.agg(F.sum("size")).first()[0] or 0
    if total <= block_words:
        return [parts.select("item", "text")]
    parts = kept(parts)
    places = 64 * -(-total // block_words)
    while True:
        place = F.pmod(F.xxhash64("item", "text"), F.lit(places))
        sizes = sorted(tuple(r) for r in parts.groupBy(place.alias("place")).agg(F.sum("size"), F.count("*")).collect())
        # A single stretch may be larger only where the bound is below the length of a window.
        if all(size <= block_words or count == 1 for _, size, count in sizes):
            break
        places *= 2
    cuts, held = [0], 0
    for at, size, _ in sizes:
        if held and held + size > block_words:
            cuts.append(at)
            held = 0
        held += size
    cuts.append(places)
    return [parts.filter((place >= a) & (place < b)).select("item", "text") for a, b in zip(cuts, cuts[1:], strict=False)]


_STATE = "struct<n_words: bigint, n_hit: bigint, marks: binary, items: array<string>>"
_ARROW_STATE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("marks", pa.binary()), ("items", pa.list_(pa.string()))]
)


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = N,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`row`, the document as it came, and `hit`: n_words, n_hit, marks (a bit per word), items as sorted strings.

    A NULL text and a text without words have no hits. An item without words
    has no window; an item without an id marks words but is not listed. Items
    that repeat count once per id.
    """
    context = docs.sparkSession.sparkContext
    df = docs.select(F.struct("*").alias("row"), F.lit(None).cast(_STATE).alias("hit"))
    blocks = _blocks(benchmark, item, item_text, n, block_words)
    for block in blocks:
        shared = context.broadcast(index_of([tuple(r) for r in block.collect()], n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                row, out = batch.column(0), []
                for whole, old in zip(pc.struct_field(row, text), batch.column(1).to_pylist(), strict=True):
                    listed = words(whole.as_py())
                    marks, items = hits(listed, index)
                    if old and old["marks"]:
                        earlier = np.unpackbits(np.frombuffer(old["marks"], np.uint8), count=len(listed)) > 0
                        marks = earlier if marks is None else marks | earlier
                    out.append(
                        {
                            "n_words": len(listed),
                            "n_hit": 0 if marks is None else int(marks.sum()),
                            "marks": None if marks is None else np.packbits(marks).tobytes(),
                            "items": sorted(items.union(old["items"] if old else ())),
                        }
                    )
                yield pa.RecordBatch.from_arrays([row, pa.array(out, _ARROW_STATE)], names=["row", "hit"])

        df = df.mapInArrow(run, df.schema)
        if len(blocks) > 1:
            df = kept(df)
    return df


def _contaminated(share: int) -> Column:
    return (F.col("hit.n_hit") > 0) & (F.col("hit.n_hit") * share >= F.col("hit.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", share: int = SHARE, **options) -> DataFrame:
    """Per document: id, n_words, n_hit, items, contaminated. `options` as in `marked`."""
    return marked(docs, benchmark, **options).select(
        F.col("row").getField(id).alias(id), "hit.n_words", "hit.n_hit", "hit.items", _contaminated(share).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return marked(docs, benchmark, **options).filter(~_contaminated(share)).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; `text` loses each stretch of hit words, up to the next word that stays."""
    df = marked(docs, benchmark, text=text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pc.struct_field(batch.column(0), "hit")
            texts = []
            for whole, marks in zip(
                pc.struct_field(batch.column(0), "text").to_pylist(), pc.struct_field(hit, "marks").to_pylist(), strict=True
            ):
                texts.append(whole if marks is None else _cut(whole, marks))
            rest = pc.struct_field(batch.column(0), "rest")
            yield pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.string())], names=["rest", "text"])

    sides = df.select(F.struct("hit", F.col("row").getField(text).alias("text"), F.col("row").alias("rest")).alias("all"))
    done = sides.mapInArrow(run, df.select(F.col("row").alias("rest"), F.lit(None).cast("string").alias("text")).schema)
    return done.select(
        *[(F.col("text") if c == text else F.col("rest").getField(c)).alias(c) for c in docs.columns]
    )


def _cut(text: str, marks: bytes) -> str:
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in re.finditer(rb"\S+", raw.translate(WORD_TABLE))]
    hit = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(spans))
    out, at = [], 0
    for i in np.flatnonzero(hit):
        out.append(raw[at : spans[i][0]] if not i or not hit[i - 1] else b"")
        at = spans[i + 1][0] if i + 1 < len(spans) else spans[i][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")
