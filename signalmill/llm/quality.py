"""A quality classifier by compression.

Two zstandard dictionaries, one from good and one from bad labelled text, each
compress a text in pieces of `PIECE` bytes, so that the dictionary and not the
text itself decides how small a piece gets. The difference of the two
compressed sizes per byte is calibrated to a probability by a logistic curve on
labelled documents that the dictionaries have not seen.

Only the fit uses a sample, and its bounds are parameters: `docs_per_class`
labelled documents of each class for the dictionaries and as many for the
calibration, chosen by hash, with `pieces_per_doc` pieces of each, spread by
hash over the whole text. Scores read whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import filtered, pieces_of, texts_of

PIECE = 128
DICTIONARY_BYTES = 1 << 16
DOCS_PER_CLASS = 2000
PIECES_PER_DOC = 16
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Model:
    """Dictionaries for good and bad text (empty: none), and the curve: score = 1 / (1 + exp(-(a + b * difference)))."""

    good: bytes
    bad: bytes
    a: float
    b: float


def fold(id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id's text modulo `folds`; fold 0 is held out from learning. NULL without an id."""
    return F.crc32(id.cast("string")) % folds


def _cut(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options).compress
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=data, **options).compress


def differences(good: bytes, bad: bytes) -> Callable[[list[str]], np.ndarray]:
    """Texts to (size with the bad dictionary - size with the good one) / bytes; 0 for an empty text."""
    small_good, small_bad = _compressor(good), _compressor(bad)

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            parts = _cut(raw)
            gain = sum(map(len, map(small_bad, parts))) - sum(map(len, map(small_good, parts)))
            out[k] = gain / max(1, len(raw))
        return out

    return run


def scores(model: Model) -> Callable[[list[str]], np.ndarray]:
    difference = differences(model.good, model.bad)
    return lambda texts: 1 / (1 + np.exp(-np.clip(model.a + model.b * difference(texts), -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, docs_per_class: int) -> DataFrame:
    """Labelled texts for learning: (text, label, fitting), one per id.

    Ids with two different labels are left out; of rows that repeat an id the
    text with the smallest hash is taken.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)")
    known = known.groupBy("_id").agg(F.min("_label").alias("label"), F.max("_label").alias("_other")).filter("label = _other")
    known = known.withColumn("_fold", fold(F.col("_id"))).filter("_fold > 0")
    chosen = None
    for value in (0, 1):
        for fitting in (True, False):
            own = known.filter((F.col("label") == value) & ((F.col("_fold") < FOLDS - 1) == fitting))
            own = own.orderBy(F.xxhash64("_id"), "_id").limit(docs_per_class).select("_id", "label", F.lit(fitting).alias("fitting"))
            chosen = own if chosen is None else chosen.unionByName(own)
    # At most 4 * docs_per_class rows, and as many again after the join, since repeats of an id become one.
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label", "fitting").agg(least)


def _dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; the pieces themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=3).as_bytes() if parts else b""
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with a slight ridge, by Newton steps."""
    wide = np.c_[np.ones(len(x)), x / (scale := max(1e-9, float(np.std(x))))]
    w, ridge = np.zeros(2), 0.01 * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -50, 50)))
        step = np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + ridge, wide.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 2)
    return float(w[0]), float(w[1] / scale)


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    docs_per_class: int = DOCS_PER_CLASS, pieces_per_doc: int = PIECES_PER_DOC,
) -> Model:
    """Learn from labelled documents outside fold 0. The curve is weighted to the labels' own shares.

    Without usable labels of both classes the score is the share of good labels
    among the usable ones, or 0.5 if there are none.
    """
    sample = _sample(docs, labels, id, text, label, docs_per_class)
    context = docs.sparkSession.sparkContext

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            parts = []
            for whole in rows["text"]:
                own = _cut((whole or "").encode("utf-8", "replace"))
                # The pieces with the smallest hashes: places all over the text.
                parts.append(sorted(own, key=zlib.crc32)[:pieces_per_doc])
            yield pa.RecordBatch.from_pydict({"label": pa.array(rows["label"], pa.int32()), "parts": pa.array(parts, pa.list_(pa.binary()))})

    taken = sample.filter("fitting").select("text", F.col("label").cast("int").alias("label")).mapInArrow(cut, "label int, parts array<binary>")
    by_class: dict[int, list[bytes]] = {0: [], 1: []}
    for row in taken.collect():
        by_class[row["label"]] += [bytes(p) for p in row["parts"]]
    good, bad = (_dictionary(sorted(by_class[k], key=zlib.crc32)) for k in (1, 0))
    shared = context.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = differences(*shared.value)
        for batch in batches:
            labels_of = batch.column(batch.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([labels_of, pa.array(difference(texts_of(batch, "text")))], names=["label", "x"])

    rest = sample.filter("NOT fitting").select("text", F.col("label").cast("int").alias("label"))
    points = rest.mapInArrow(measure, "label int, x double").collect()
    usable = labels.filter((fold(F.col(id)) > 0) & F.col(label).isin(0, 1))
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    x, y = np.array([p["x"] for p in points]), np.array([p["label"] for p in points], float)
    if not by_class[0] or not by_class[1] or len(set(y)) < 2:
        prior = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        return Model(good, bad, float(np.log(prior / (1 - prior))), 0.0)
    a, b = _curve(x, y)
    # The sample takes equal numbers of both classes where it can; move the odds back to all labels.
    own = y.mean()
    prior = min(max(share, 1e-6), 1 - 1e-6)
    return Model(good, bad, a + float(np.log(prior / (1 - prior)) - np.log(own / (1 - own))), b)


def scored(
    docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Per document: id, held_out, score, predicted (1 if score >= threshold). Without an id, held_out is false."""
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.a, model.b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scores(Model(*shared.value))
        for batch in pieces_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(texts_of(batch, "text")))], names=["id", "score"])

    kind = docs.schema[id].dataType.simpleString()
    done = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return done.select(
        F.col("id").alias(id),
        F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least `threshold`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.a, model.b))

    def keep() -> Callable[[list[str]], list[bool]]:
        score = scores(Model(*shared.value))
        return lambda texts: (score(texts) >= threshold).tolist()

    return filtered(docs, text, keep)
