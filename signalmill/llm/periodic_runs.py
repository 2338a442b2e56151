"""Periodic runs in texts, by a sparse dynamic programme over diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least max(6, 4 q) words long, that no neighbouring word
extends. The programme goes over the words of a text and keeps, for each lag
between a word and an earlier occurrence of it, how many words in a row have
matched at that lag: the diagonal of the lag. A match lengthens its diagonal by
one, a miss ends it, and an ended diagonal of m matches at lag p is a run if
m >= 3 p and m + p >= 6.

Frequent words have too many earlier occurrences, so the lags are taken by
scale: those of 1, of 2 to 3, of 4 to 7 and so on. A run of lag p >= 2^k holds
3 * 2^k matches in a row, so at scale k a word only counts together with the
3 * 2^k - 1 words before it, and of their earlier occurrences only the nearest
one. That loses nothing: if such a gram also occurs at a smaller lag q than p,
the words from its first occurrence on have both periods, are no shorter than
p + q, and so have period gcd(p, q) (Fine and Wilf), and the whole run with
them; its smallest period is not p. It also leaves no run with a period that
is a multiple of its smallest one. Grams of a scale are named exactly, from two
of the scale before, and only those that occur again are carried on, so plain
prose ends after the first scale and the worst text costs n log n.

Defined cases. A NULL or empty text has no words, no runs and collapses to the
empty text. Every row is a result of its own, also without an id or repeated.
Memory is about twenty times the longest text; short ones go in pieces of
`common.PIECE` bytes. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from signalmill.llm.common import pieces_of

LEAST = 6
# Matches in a row that a run of lag p must have, as a multiple of p.
MATCHES = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs, equal for equal pairs only. Both sides hold numbers below their count."""
    return np.unique(left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _repeated(names: np.ndarray) -> np.ndarray:
    return np.bincount(names)[names] > 1


def _diagonals(at: np.ndarray, lag: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, length, period) of matches at ascending positions: neighbours of one lag are one diagonal."""
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(lag) != 0))))
    matches = np.diff(np.append(first, len(at))) + gram - 1
    period, start = lag[first], at[first] - (gram - 1) - lag[first]
    enough = (matches >= MATCHES * period) & (matches + period >= LEAST)
    return start[enough], (matches + period)[enough], period[enough]


def _recurring(words: np.ndarray, starts: np.ndarray, gram: int) -> np.ndarray:
    """Positions where a gram ends that may occur again, by a hash of its words."""
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    total = mixed.copy()
    for back in range(1, gram):
        total *= _MIX
        total[back:] += mixed[:-back]
    inside = np.flatnonzero(np.arange(len(words)) - starts >= gram - 1)
    hashes = total[inside]
    order = np.sort(hashes)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return inside[:0]
    place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return inside[twice[place] == hashes]


def find_runs(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, length, period), by start and period, of texts laid end to end.

    `words` numbers the words, differently in each text; `starts` is, at every
    word, the position of its text's first word.
    """
    n = len(words)
    next_to = np.flatnonzero(words[1:] == words[:-1]) + 1
    found = [_diagonals(next_to, np.ones(len(next_to), np.int64), 1)]
    scale, gram = 2, MATCHES * 2
    at = _recurring(words, starts, gram)
    names = words[at]
    for back in range(1, gram):
        names = _names(names, words[at - back])
    while len(at):
        again = _repeated(names)
        at, names = at[again], names[again]
        order = np.argsort(names, kind="stable")
        nearest = np.zeros(len(at), np.int64)
        nearest[order[1:]] = np.where(np.diff(names[order]) == 0, np.diff(at[order]), 0)
        own = (nearest >= scale) & (nearest < 2 * scale)
        found.append(_diagonals(at[own], nearest[own], gram))
        # Grams of twice the length: both halves occur again.
        name_at = np.full(n, -1, np.int64)
        name_at[at] = names
        whole = at - 2 * gram + 1 >= starts[at]
        at, names = at[whole], names[whole]
        before = name_at[at - gram]
        at, names, before = at[before >= 0], names[before >= 0], before[before >= 0]
        names = _names(names, before)
        scale, gram = 2 * scale, 2 * gram
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and the position of each text's first word, with the end of all."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    true_word = pc.greater(pc.binary_length(words), 0)
    counted = np.concatenate(([0], np.cumsum(true_word.to_numpy(zero_copy_only=False))))
    return words.filter(true_word), counted[offsets - offsets[0]]


def _found(ids: pa.Array, texts: pa.Array, names: list[str]) -> pa.RecordBatch:
    words, bounds = _split(texts)
    sizes = np.diff(bounds)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    own_codes = text * (int(codes.max(initial=0)) + 1) + codes
    if len(own_codes):
        # Below the number of words, so that pairs of names fit 64 bits.
        own_codes = np.unique(own_codes, return_inverse=True)[1]
    start, length, period = find_runs(own_codes, bounds[:-1][text])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change[:-1]) == 0
    left = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(stays)))[bounds], pa.int32()), words.filter(pa.array(stays))
    )
    owner = np.searchsorted(bounds, start, side="right") - 1
    runs = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start - bounds[owner], length, period)], fields=list(_RUN)
    )
    run_bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes)))))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(run_bounds, pa.int32()), runs),
            pc.binary_join(left, " "),
        ],
        names=names,
    )


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start and period) and collapsed.

    `collapsed` is the text without the words that some run repeats after its
    first period, the rest joined by one space.
    """
    names = [id, "n_words", "runs", "collapsed"]
    kinds = [docs.schema[id].dataType.simpleString(), "bigint", "array<struct<start: bigint, length: bigint, period: bigint>>", "string"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "_text"):
            yield _found(piece.column("_id"), piece.column("_text"), names)

    return docs.selectExpr(f"`{id}` AS _id", f"`{text}` AS _text").mapInArrow(work, schema)
