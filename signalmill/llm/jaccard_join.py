"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Documents are sets of word 5-grams; two documents are linked if the Jaccard
similarity of their sets is 0.8 or more.

1. Each text gets a sketch: a digest of its set, `BANDS` x `ROWS` MinHash
   values, and one key per band. Equal sets collapse to one representative.
2. Representatives that share a band key form a bucket. Buckets with the same
   members are one. Inside a bucket the MinHash values of each pair are
   compared `STEP` at a time, and a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold, given the matches so
   far and a uniform prior, falls below `TOLERANCE`. What survives goes on as a
   spanning star, so a bucket yields fewer rows than it has members.
3. The components of the stars are candidate clusters: no link leaves one. In a
   cluster the pairs are pruned the same way and the rest is verified exactly
   on the sets, which are made again from the texts. Each document yields its
   number of links and one star edge; the links themselves are counted in
   place and never become rows.
4. Components of the verified stars are the classes.

A large bucket or cluster is dealt into blocks of about `BLOCK` members and each
pair of blocks is a group of its own, so no task holds more than two blocks.
Nothing is capped: every pair of a bucket or cluster is compared.

A pair of similarity 0.8 shares no band with probability 3e-6; each of the ten
pruning steps loses it with a probability of about `TOLERANCE`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.common import kept, once_per_worker, words
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

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
STEP = 16
TOLERANCE = 1e-6
BLOCK = 400
KNOWN_WORDS = 200_000

_RANDOM = np.random.default_rng(5_281)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(listed: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the word n-grams; a text of fewer words, but not none, is one n-gram."""
    if not listed:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, listed), np.uint64, len(listed))
    size = min(size, len(own))
    out = np.full(len(own) - size + 1, size, np.uint64)
    for i in range(size):
        out += own[i : len(own) - size + 1 + i] * _PLACES[i]
    return np.unique(mixed(out))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    lowest = np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * _FACTORS + _SHIFTS
        lowest = np.minimum(lowest, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return lowest


def band_keys(lowest: np.ndarray) -> np.ndarray:
    rows = lowest.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * _PLACES[8] + rows[:, i])
    return keys.view(np.int64)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on).

    With a uniform prior and m matches of n values the posterior of the
    similarity is Beta(m + 1, n - m + 1), so P(similarity >= t) is the
    probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(
    values: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows that may reach the threshold."""
    # The smaller set over the larger one bounds the similarity.
    able = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[able], b[able]
    matches, before = np.zeros(len(a), np.int32), 0
    for n, least in least_matches(threshold, tolerance):
        matches = matches + (values[a, before:n] == values[b, before:n]).sum(axis=1, dtype=np.int32)
        going = matches >= least
        a, b, matches, before = a[going], b[going], matches[going], n
    return a, b


def sketches(docs: DataFrame, id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """id, text_hash, digest, size and, for texts with words, values (16 bits each) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = once_per_worker(("word hashes",), WordHashes)
        for batch in batches:
            digests, sizes, values, bands = [], [], [], []
            for whole in batch.column(2):
                found = shingles(words(whole.as_py()), hashes, shingle)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                lowest = signature(found) if len(found) else None
                values.append(None if lowest is None else lowest.astype(np.uint16).tobytes())
                bands.append(None if lowest is None else band_keys(lowest))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(values, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "text_hash", "digest", "size", "values", "bands"],
            )

    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, "id bigint, text_hash bigint, digest binary, size int, values binary, bands array<bigint>"
    )


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _candidates(reps: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(a, b): edges between nodes that connect the pairs of each bucket that survive the pruning.

    A task contracts what it finds in all its buckets, always to the smallest
    node, so near copies that meet in most bands yield few different edges.
    """
    keys = reps.select("node", F.explode("bands").alias("key"))
    mixed = F.xxhash64("node")
    buckets = keys.groupBy("key").agg(
        F.count("*").alias("members"), F.min(mixed).alias("low"), F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(3))).alias("y")
    )
    # Two documents alike meet in most bands; a set of members is looked at once.
    buckets = buckets.filter("members > 1").groupBy("members", "low", "x", "y").agg(F.min("key").alias("key"))
    found = keys.join(buckets.select("key", "members"), "key").join(reps.select("node", "size", "values"), "node")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in groups_of(batches, ["key", "first", "second"]):
            starts = [*starts_of(rows, ["key", "first", "second"]), rows.num_rows]
            values, sizes = _matrix(rows.column("values")), rows.column("size").to_numpy()
            node, sides = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            first, second = rows.column("first").to_numpy(), rows.column("second").to_numpy()
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for at, end in zip(starts, starts[1:], strict=False):
                for a, b in row_pairs(sides[at:end], first[at] == second[at]):
                    waiting.append((a + at, b + at))
                    held += len(a)
                if held >= PAIRS or end == rows.num_rows:
                    a, b = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, int),) * 2
                    a, b = survivors(values, sizes, a, b, threshold, tolerance)
                    yield node[a], node[b]
                    waiting, held = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in stars(edges(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sort_by_group(deal_out(found, "key", "node", block), "key").mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(
    docs: DataFrame, clusters: DataFrame, id: str, text: str, shingle: int, threshold: float, tolerance: float, block: int
) -> DataFrame:
    """(node, root, links) per representative and pair of blocks where it has a link."""
    texts = docs.select(F.col(id).alias("rep"), F.col(text).alias("text"))
    rows = deal_out(texts.join(clusters, "rep").drop("rep"), "cluster", "node", block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = once_per_worker(("word hashes",), WordHashes)
        for many in groups_of(batches, ["cluster", "first", "second"]):
            starts = [*starts_of(many, ["cluster", "first", "second"]), many.num_rows]
            for at, end in zip(starts, starts[1:], strict=False):
                found = _links(many.slice(at, end - at), hashes, shingle, threshold, tolerance)
                yield from found.to_batches()

    return sort_by_group(rows, "cluster").mapInArrow(run, "node bigint, root bigint, links bigint")


def _links(group: pa.Table, hashes: WordHashes, shingle: int, threshold: float, tolerance: float) -> pa.Table:
    """Representatives of a group that have links: themselves, the first row they reach, their links."""
    place, sets = {}, []
    for k, (text, digest) in enumerate(zip(group.column("text"), group.column("digest").to_pylist(), strict=True)):
        if digest not in place:
            found = shingles(words(text.as_py()), hashes, shingle)
            # Another text under the same id is not the representative.
            if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == digest:
                place[digest] = k
                sets.append(found)
    group = group.take(pa.array(place.values(), pa.int64()))
    values, sizes = _matrix(group.column("values")), np.array([len(s) for s in sets], np.int64)
    sides = group.column("side").to_numpy()
    same = not sets or group.column("first")[0].equals(group.column("second")[0])
    shared = shared_counts(sets)
    links, left = np.zeros(len(sets), np.int64), [(np.zeros(0, np.int64),) * 2]
    for a, b in row_pairs(sides, same):
        a, b = survivors(values, sizes, a, b, threshold, tolerance)
        common = shared[a, b].astype(np.int64)
        true = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
        a, b = a[true], b[true]
        links += np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
        left.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*left, strict=True))
    root, some, node = roots(len(sets), a, b), np.flatnonzero(links), group.column("node").to_numpy()
    return pa.table({"node": node[some], "root": node[root[some]], "links": links[some]})


def _classes(
    docs: DataFrame, id: str, text: str, shingle: int, threshold: float, tolerance: float, block: int
) -> DataFrame:
    """Per row: id, text_hash, class_id, n_links, n_copies."""
    rows = kept(sketches(docs, id, text, shingle).withColumn("part", F.expr("spark_partition_id() div 8")))
    named = rows.filter("id IS NOT NULL AND size > 0")
    reps = named.groupBy("digest").agg(
        F.min(F.struct("id", "size", "values", "bands")).alias("low"), F.count("*").alias("copies")
    )
    reps = kept(
        reps.select(
            "digest", F.monotonically_increasing_id().alias("node"), F.col("low.id").alias("rep"), "low.size", "low.values", "low.bands", "copies"
        )
    )
    near = components(_candidates(reps, threshold, tolerance, block))
    sized = near.groupBy("component").agg(F.count("*").alias("members"))
    clusters = (
        near.join(sized, "component")
        .select(F.col("id").alias("node"), F.col("component").alias("cluster"), "members")
        .join(reps.select("node", "digest", "rep", "values"), "node")
    )
    links = kept(_verified(docs, clusters, id, text, shingle, threshold, tolerance, block))
    linked = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = linked.join(counted, "node").join(reps.select("node", "rep"), "node")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = linked.join(lowest, "component").select("node", "n_links", "class_id")
    told = reps.select("node", "digest", "rep", "copies").join(linked, "node", "left")
    told = told.select(
        "digest",
        F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )
    # Copies of one set may be most of all rows: they meet its class once per eight partitions.
    spread = named.select("digest", "part").distinct().join(told, "digest")
    found = named.select("id", "text_hash", "digest", "part").join(spread, ["digest", "part"]).drop("digest", "part")
    alone = rows.filter("id IS NULL OR size = 0").select(
        "id", "text_hash", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies")
    )
    return found.unionByName(alone)


def classes(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, class_id, n_links, n_copies.

    class_id is the smallest id of the documents that links and equal sets
    connect; n_links counts the different sets that the document's set is linked
    to; n_copies counts the documents with the same set. A text without words is
    alone in its class. So is a row without an id, with class_id NULL. Ids are
    integers.
    """
    return _classes(docs, id, text, shingle, threshold, tolerance, block).select(
        F.col("id").alias(id), "class_id", "n_links", "n_copies"
    )


def one_of_each_class(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """The documents with the smallest id of their class, with all their columns; of repeated rows, one."""
    found = _classes(docs, id, text, shingle, threshold, tolerance, block)
    first = found.filter("id = class_id").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"), F.struct("*").alias("_row"))
    named = rows.filter("_id IS NOT NULL").join(first, ["_id", "_hash"], "left_semi")
    # One class may hold several texts under its smallest id; the join has sorted the rows already.
    place = Window.partitionBy("_id", "_hash").orderBy("_id", "_hash")
    once = named.withColumn("_n", F.row_number().over(place)).filter("_n = 1")
    return once.select("_row.*").unionByName(docs.filter(F.col(id).isNull()))
