"""Helpers that several operators share.

Rules that hold for all operators here, unless their docstring says otherwise:

* A NULL text counts as the empty text. A row without an id takes part in no
  group, index or training set; it is kept and reported on its own.
* Rows that repeat both id and text are one document for grouping operators.
* Other columns of the input are never looked at. Operators that filter rows
  return them as they came, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from signalmill.functions.sql import each
from signalmill.operators.stable import stable

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# Bytes of text that a worker holds as Python or numpy objects at once, or one text.
PIECE = 1 << 22
# A-Z to lower case, every other ASCII character that is no digit or letter to a space.
WORD_TABLE = bytes(
    i + 32 if 0x41 <= i <= 0x5A else 0x20 if i in _SEPARATORS else i for i in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that later steps never redo them."""
    return stable(df)


def once_per_worker(key: tuple, make: Callable[[], object]) -> object:
    """A value made once in a Python worker and used by the tasks that it runs.

    Functions travel to the workers by value, which makes module globals anew in
    every task; an attribute of `sys` lives as long as the worker. A worker holds
    one such value: the next operator that asks for another one drops it, so a
    chain of operators needs no more memory than the largest of them.
    """
    store = sys.__dict__.setdefault("_signalmill_worker", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, then runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "replace").translate(WORD_TABLE).split()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, NULL as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about `PIECE` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        first, held = 0, 0
        for k, size in enumerate(sizes):
            if k > first and held + size > PIECE:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def filtered(
    df: DataFrame, text: str, keep: Callable[[], Callable[[list[str]], list[bool]]]
) -> DataFrame:
    """The rows whose text `keep()(texts)` accepts, with all their columns as they came.

    `keep` is called once per task, so that a model is set up on the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = keep()
        for batch in pieces_of(batches, text):
            yield batch.filter(pa.array(accept(texts_of(batch, text)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def listed(spans: str = "spans") -> str:
    """SQL for `kind:start:end` of spans, comma-joined."""
    return f"array_join({each(spans, lambda x: f'concat_ws(\':\', {x}.kind, {x}.start, {x}.end)')}, ',')"
