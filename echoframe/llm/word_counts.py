"""Corpus-wide counts of words and word sequences, given back to each group of documents.

A group asks with its distinct keys in order (words: 64-bit hashes; pairs and triples:
hashes of as many bits as the corpus needs) and how often its training documents hold
each.  Keys are cut into ranges; whoever holds a range adds up what all groups say of
it and answers each with the totals of its keys, so nothing that grows with the
vocabulary is broadcast or leaves the ranges.

A group cuts its keys into at most FAN ranges.  Where the corpus needs more, about FAN groups
first merge what they hold of a coarse range, only the merged keys are cut into fine
ranges, and the totals come back the same way: blocks keep their size, and rows stay in
proportion to the input, however many groups there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import U64

FAN = 4096
WORDS, GRAMS, SUMS = 0, 1, 2
COLUMNS = "kind int, owner long, bucket long, keys binary, counts binary"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def table(rows: list[tuple]) -> pa.Table:
    """A table of COLUMNS."""
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _TYPES)], ["kind", "owner", "bucket", "keys", "counts"])


def pressed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint32).tobytes())


def unpressed(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint32)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    planes = np.diff(keys, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=U64)


class Ranges:
    """Equal ranges of the keys of `bits` bits: `fine` of them, and coarse ones of `per` fine ones each, at most `fan`."""

    def __init__(self, bits: int, fine: int, fan: int = FAN):
        self.width = -(-(1 << bits) // fine)
        self.fine, self.fan = fine, fan
        self.per = -(-fine // fan)
        self.coarse = -(-fine // self.per)

    def cut(self, keys: np.ndarray, low: int = 0, high: int | None = None, per: int = 1) -> list[tuple[int, int, int]]:
        """(range, start, end) of the ranges from low to high that hold some of the sorted keys, `per` fine ranges making one."""
        high = -(-self.fine // per) if high is None else high
        edges = [min(k * per * self.width, (1 << 64) - 1) for k in range(low, high)]
        at = np.append(np.searchsorted(keys, np.array(edges, dtype=U64)), len(keys))
        at[0] = 0
        filled = np.flatnonzero(at[1:] > at[:-1])
        return [(low + int(k), int(at[k]), int(at[k + 1])) for k in filled]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted runs, in order, and the sums of their counts."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[start], np.add.reduceat(np.concatenate(counts)[order], start, dtype=np.int64)


def asks(kind: int, owner: int, keys: np.ndarray, counts: np.ndarray, ranges: Ranges) -> list[tuple]:
    """The rows with which a group asks for its keys."""
    return [(kind, owner, b, packed(keys[x:y]), pressed(counts[x:y])) for b, x, y in ranges.cut(keys, per=ranges.per)]


def _held(blocks: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpacked(raw) for raw in blocks.column("keys").to_pylist()], [unpressed(raw) for raw in blocks.column("counts").to_pylist()]


def _answers(blocks: pa.Table, distinct: np.ndarray, total: np.ndarray, keys: list[np.ndarray]) -> list[tuple]:
    rows = zip(blocks.column("kind").to_pylist(), blocks.column("owner").to_pylist(), blocks.column("bucket").to_pylist(), keys)
    return [(kind, owner, bucket, b"", pressed(total[np.searchsorted(distinct, k)])) for kind, owner, bucket, k in rows]


def _adder(sums_of):
    """For a fine range: totals for each asker; of words also what sums_of says of them (kind SUMS)."""
    def run(blocks: pa.Table) -> pa.Table:
        keys, counts = _held(blocks)
        distinct, total = merged(keys, counts)
        rows = _answers(blocks, distinct, total, keys)
        if blocks.column("kind")[0].as_py() == WORDS:
            rows.append((SUMS, 0, blocks.column("bucket")[0].as_py(), *sums_of(distinct, total)))
        return table(rows)

    return run


def _uniter(ranges: dict[int, Ranges]):
    """For a team of about FAN groups and a coarse range: its merged keys, as asks to the fine ranges in it."""
    def run(blocks: pa.Table) -> pa.Table:
        kind, bucket, team = (blocks.column(c)[0].as_py() for c in ("kind", "bucket", "team"))
        distinct, total = merged(*_held(blocks))
        r = ranges[kind]
        cuts = r.cut(distinct, bucket * r.per, min((bucket + 1) * r.per, r.fine))
        return table([(kind, team, b, packed(distinct[x:y]), pressed(total[x:y])) for b, x, y in cuts])

    return run


def _divider(blocks: pa.Table, totals: pa.Table) -> pa.Table:
    """The totals of a coarse range, which came in its fine ranges, to each of the groups that asked."""
    keys, counts = _held(blocks)
    distinct, _ = merged(keys, counts)
    order = np.argsort(totals.column("bucket").to_numpy())
    parts = totals.column("counts").to_pylist()
    return table(_answers(blocks, distinct, np.concatenate([unpressed(parts[k]) for k in order]), keys))


def totals(asked: DataFrame, ranges: dict[int, Ranges], sums_of, owners: int) -> DataFrame:
    """Answers (COLUMNS) to the rows of asks() of so many owners: for each its kind, owner and bucket, and the totals of its keys in order; and rows of SUMS.

    sums_of gives two byte strings from the distinct words of a range and their totals.
    """
    deep = {k for k, r in ranges.items() if r.per > 1}
    parts = []
    flat = asked.filter(~F.col("kind").isin(*deep)) if deep else asked
    if len(deep) < len(ranges):
        parts.append(flat.groupBy("kind", "bucket").applyInArrow(_adder(sums_of), COLUMNS))
    if deep:
        fan = next(iter(ranges.values())).fan
        teams = asked.filter(F.col("kind").isin(*deep)).withColumn("team", F.pmod(F.xxhash64("owner"), F.lit(-(-owners // fan))))
        united = teams.groupBy("kind", "team", "bucket").applyInArrow(_uniter(ranges), COLUMNS)
        found = written(united.groupBy("kind", "bucket").applyInArrow(_adder(sums_of), COLUMNS), "ranges")
        per = F.when(F.col("kind") == WORDS, F.lit(ranges[WORDS].per)).otherwise(F.lit(ranges[GRAMS].per))
        back = found.filter(F.col("kind") != SUMS).withColumn("team", F.col("owner")).withColumn("coarse", F.floor(F.col("bucket") / per).cast("long"))
        parts.append(teams.groupBy("kind", "team", "bucket").cogroup(back.groupBy("kind", "team", "coarse")).applyInArrow(_divider, COLUMNS))
        parts.append(found.filter(F.col("kind") == SUMS))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def answered(answers: pa.Table, kind: int, keys: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Totals of a group's sorted keys from the answers to it."""
    out = np.zeros(len(keys), dtype=np.uint32)
    at = {b: (x, y) for b, x, y in ranges.cut(keys, per=ranges.per)}
    for k, b, c in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("counts")):
        if k == kind:
            x, y = at[b]
            out[x:y] = unpressed(c.as_py())
    return out
