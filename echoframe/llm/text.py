"""Ragged word kernels over Arrow string buffers.

Every text operator of this subpackage sees a column of texts as one byte
buffer plus document offsets and works on whole buffers with numpy, so no
Python object is made per word.  Words are runs of bytes of a byte class; that
equals the code-point classes of the contracts because all bytes of non-ASCII
characters are above 0x7F and belong to every word class used here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_WINDOW = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD1342543DE82EF95)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, _WINDOW)
        inverse = pow(int(_BASE), -1, 1 << 64)
        up = np.full(n, _BASE, dtype=U64)
        down = np.full(n, U64(inverse), dtype=U64)
        up[0] = down[0] = U64(1)
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a buffer: hash, start and end byte of each, and the first word of each document."""

    __slots__ = ("hash", "start", "end", "first")

    def __init__(self, hash_, start, end, first):
        self.hash, self.start, self.end, self.first = hash_, start, end, first


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> Words:
    """Split into words and hash each (64 bits, of the folded bytes)."""
    n = len(data)
    hashes, starts, ends = [], [], []
    lo = 0
    while lo < n:
        width = _WINDOW
        while True:
            hi = min(n, lo + width)
            part = fold[data[lo:hi]]
            inside = member[part]
            if hi == n:
                break
            outside = np.flatnonzero(~inside[::-1])
            cut = hi - int(outside[0]) if len(outside) else lo
            cut = max(cut, int(offsets[np.searchsorted(offsets, hi, side="right") - 1]))
            if cut > lo:
                hi = cut
                part, inside = part[: hi - lo], inside[: hi - lo]
                break
            width *= 2
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        cuts = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left")] - lo
        if len(cuts):
            begin[cuts] |= inside[cuts]
            stop[cuts - 1] |= inside[cuts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop)
        if len(s):
            up, down = _power_tables(hi - lo)
            value = _BYTE[part] * up[: hi - lo]
            total = np.cumsum(value, dtype=U64)
            h = (total[e] - total[s] + value[s]) * down[s]
            hashes.append(mix64(h + (e - s + 1).astype(U64)))
            starts.append(s + lo)
            ends.append(e + (lo + 1))
        lo = hi
    if hashes:
        h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    else:
        h, s, e = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(h, s, e, np.searchsorted(s, offsets, side="left"))


def hash_words(texts: list[str], member: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> list[np.ndarray]:
    """Word hashes of each of a few texts."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    w = words(data, offsets, member, fold)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (a shorter document: one run of all its words) and len+1 offsets by document."""
    first = w.first
    counts = np.diff(first)
    n = len(w.hash)
    keys = (np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    full = np.zeros(max(n, 1), dtype=U64)
    for k in range(size):
        full[: n - k] += mix64(w.hash[k:] ^ keys[k]) if n > k else U64(0)
    full = mix64(full)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    position = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made) + np.repeat(first[:-1], made)
    out = full[position]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = first[d], first[d + 1]
        out[offsets[d]] = mix64(np.array([sum(int(x) for x in mix64(w.hash[a:b] ^ keys[: b - a])) & (2**64 - 1) ^ int(b - a)], dtype=U64))[0]
    return out, offsets
