"""Periodic runs of words by probing a harmonic grid.

A run of period p and of 2p words or more holds two neighbouring points jp and (j+1)p of
p's grid, and their words are equal.  So for every p, in blocks of periods, the words at
neighbouring grid points are compared: n/1 + n/2 + n/3 ... probes, n log n in all.
Survivors are extended to both sides, a chunk of words of all survivors at a time; what is
still equal after REACH words is extended alone, in chunks that double.  Grid points within
a run already found are skipped if its period divides p, as they can only find it again.

Words are numbered exactly (by a dictionary of each batch), so runs don't rest on hashes.
Every document is worked on by itself, without a shuffle; memory is in proportion to the
longest text and to blocks of PROBES grid points.

Defined results: a null text, an empty one and one of blanks have no words, no runs and the
empty collapsed text; a text shorter than the shortest run has none and is collapsed to its
words with single blanks; repeated rows give repeated results; an empty table gives an
empty result; very long texts are searched whole; doc_id may be of any type and null;
further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Ragged
from .shared import pieces
from .text import IDENTITY, NOT_SPACE, buffers, words

#: Grid points that are compared at once, and words to each side that all survivors are extended by at once.
PROBES, REACH = 1 << 16, 16
WORD = "[^\\x20\\x09-\\x0D]+"


class _Found:
    """The runs of one document, and for each word the longest run over it."""

    def __init__(self, n: int, shortest: int):
        self.n, self.shortest = n, shortest
        self.period: dict[tuple[int, int], int] = {}
        self.end, self.size, self.of = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)

    def add(self, start: int, end: int, p: int) -> None:
        """A stretch from start to end (exclusive) that p maximally spans; its least period counts."""
        if end - start < max(self.shortest, 2 * p) or self.period.get((start, end), p + 1) <= p:
            return
        self.period[start, end] = p
        at = slice(start, end)
        shorter = self.size[at] < end - start
        for held, value in ((self.end, end), (self.size, end - start), (self.of, p)):
            held[at][shorter] = value

    def covers(self, at, p):
        """Whether at and at + p lie within a run whose period divides p."""
        return (self.end[at] > at + p) & (p % self.of[at] == 0)


def _equal(w: np.ndarray, at: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
    """How many of the next REACH words (step 1: to the right, -1: to the left) equal those p words on."""
    k = at[:, None] + step * np.arange(1, REACH + 1)
    inside = (k >= 0) & (k + p[:, None] < len(w))
    same = inside & (w[np.where(inside, k, 0)] == w[np.where(inside, k + p[:, None], 0)])
    return np.where(same.all(axis=1), REACH, same.argmin(axis=1))


def _extend(w: np.ndarray, at: int, p: int, step: int) -> int:
    """The last word from at on, in direction step, up to which words equal those p words on."""
    size = 4 * REACH
    while True:
        if step > 0:
            same = w[at + 1 : min(at + 1 + size, len(w) - p)] == w[at + 1 + p : at + 1 + p + size]
        else:
            same = (w[max(at - size, 0) : at] == w[max(at - size, 0) + p : at + p])[::-1]
        good = len(same) if same.all() else int(same.argmin())
        at += step * good
        if good < size:
            return at
        size *= 2


def _blocks(n: int):
    """Ranges of periods, of about PROBES grid points each; period 1 alone, as its runs cover most others'."""
    low, top = 1, n // 2
    while low <= top:
        if low == 1:
            high = 2
        else:
            points = np.cumsum((n - 1) // np.arange(low, min(top, low + PROBES) + 1))
            high = low + max(1, int(np.searchsorted(points, PROBES, side="right")))
        yield np.arange(low, min(high, top + 1))
        low = high


def find_runs(w: np.ndarray, shortest: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the numbered words w, by start and period.

    A run is a stretch of least period q, of at least `shortest` and of 2q words, that can't be
    extended to either side.
    """
    n = len(w)
    if n < max(shortest, 2):
        return []
    found = _Found(n, shortest)
    for periods in _blocks(n):
        points = (n - 1) // periods
        p = np.repeat(periods, points)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(points) - points, points)) * p
        hit = np.flatnonzero(w[at] == w[at + p])
        at, p = at[hit], p[hit]
        new = ~found.covers(at, p)
        at, p = at[new], p[new]
        for a in range(0, len(at), PROBES // 8):
            _grow(w, at[a : a + PROBES // 8], p[a : a + PROBES // 8], found)
    return sorted((start, end - start, q) for (start, end), q in found.period.items())


def _grow(w: np.ndarray, at: np.ndarray, p: np.ndarray, found: _Found) -> None:
    """Extend the survivors at (period p, in order of p and at)."""
    right, left = _equal(w, at, p, 1), _equal(w, at, p, -1)
    need = np.maximum(found.shortest - p, p)  # fewer equal words than this are no run
    far = (right == REACH) | (left == REACH)
    for k in np.flatnonzero(~far & (right + left + 1 >= need)):
        found.add(int(at[k] - left[k]), int(at[k] + right[k] + p[k] + 1), int(p[k]))
    last, until = 0, -1
    for k in np.flatnonzero(far):
        a, q = int(at[k]), int(p[k])
        if (q == last and a <= until) or found.covers(a, q):
            continue
        last, until = q, _extend(w, a + int(right[k]), q, 1) if right[k] == REACH else a + int(right[k])
        start = _extend(w, a - int(left[k]), q, -1) if left[k] == REACH else a - int(left[k])
        found.add(start, until + q + 1, q)


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapse(shortest: int = 12):
    """A function over Arrow batches of (doc_id, text): doc_id, runs, collapsed text."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in pieces(batches):
            data, offsets = buffers(batch.column("text"))
            found = words(data, offsets, NOT_SPACE, IDENTITY)
            length = found.end - found.start
            ends = np.cumsum(length)
            letters = data[NOT_SPACE[data]]
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(letters)])
            number = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            runs, stays = [], np.ones(len(number), dtype=bool)
            for a, b in zip(found.first[:-1], found.first[1:]):
                runs.append(find_runs(number[a:b], shortest))
                if runs[-1]:
                    stays[a:b] = _kept(b - a, runs[-1])
            # kept words, each with a blank in front of it, but for the first of a document
            rows = np.flatnonzero(stays)
            doc = np.searchsorted(found.first, rows, side="right") - 1
            size = length[rows] + 1
            joined = np.full(int(size.sum()), 0x20, dtype=np.uint8)
            begin = np.cumsum(size) - size
            inside = np.ones(len(joined), dtype=bool)
            inside[begin] = False
            joined[inside] = Ragged(letters, np.append(0, ends)).take(rows)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            joined = np.delete(joined, begin[first[:-1][first[1:] > first[:-1]]])
            total = np.append(0, np.cumsum(size - 1))[first] + np.append(0, np.cumsum(np.maximum(np.diff(first) - 1, 0)))
            collapsed = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(joined))
            rows_of = pa.array([[dict(zip(("start", "length", "period"), r)) for r in one] for one in runs], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows_of, collapsed.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of docs: all periodic runs of its words, and its text with each run cut to its first period."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(collapse(shortest), f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: least start, then least period), or null."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document by crc32 of its id repeats a stretch of its words from some word on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n = F.size("w")
    d = d.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
