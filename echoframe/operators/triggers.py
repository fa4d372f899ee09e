"""The trigger of the adaptive detector over series of any length, chunk by chunk.

What the trigger does with a value depends on its state: the noise floor (a mean over the
last values, frozen while it is open), the decaying maximum, open or closed.  Chunks of a
series start from guesses, all at once: the state after the last values before the chunk.
Where the state in which a chunk ends isn't the one in which the next one started, that one
alone runs again, until all fit.  States forget (the floor after a window, the maximum where
it is passed), so few chunks run twice; at worst a series of k chunks takes k rounds.  The
result is that of one pass from the first value, whatever the chunks.

Defined results: null values are left out; an empty table, and series of fewer than two
values, give no spans; a trigger still open at the end gives none; rows that tie in all order
columns come in any order.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spectra import FLOOR
from ..functions.tracks import decayed
from .scans import chunks
from .storage import stored

SPAN = "start: long, stop: long, peak: long, level: double"
_HEAD = struct.Struct("<?qdqqdd")


@dataclass(frozen=True)
class Settings:
    """threshold (dB over the floor), values in the noise window, decay of the maximum, and values after which an open trigger lets the floor move again."""

    threshold: float = 14
    window: int = 195
    edg: float = 0.996
    longest: int = 156


@dataclass
class State:
    """Between two values; the floor is the mean of ring, or the first value while it is empty."""

    ring: list[float]
    seed: float
    ceiling: float = -np.inf
    open: bool = False
    held: int = 0
    begun: int = 0
    peak: int = 0
    best: float = -120.0

    def packed(self) -> bytes:
        """Equal states have equal bytes; the first value is forgotten when the ring holds another."""
        return _HEAD.pack(self.open, self.held, self.best, self.begun, self.peak, self.ceiling, 0.0 if self.ring else self.seed) + struct.pack(f"<{len(self.ring)}d", *self.ring)

    @classmethod
    def unpacked(cls, raw: bytes) -> State:
        open_, held, best, begun, peak, ceiling, seed = _HEAD.unpack_from(raw)
        return cls(list(struct.unpack(f"<{(len(raw) - _HEAD.size) // 8}d", raw[_HEAD.size :])), seed, ceiling, open_, held, begun, peak, best)


def run(state: State | None, first: int, values: list[float], s: Settings) -> tuple[list[tuple[int, int, int, float]], State | None]:
    """(start, stop, peak, level) of the triggers that close among values, which are at places first and on, and the state after them; None starts with the first value."""
    spans = []
    if state is None:
        if not values:
            return spans, None
        state, values, first = State([], values[0]), values[1:], first + 1
    ring = list(state.ring)
    open_, held, best, begun, peak, ceiling = state.open, state.held, state.best, state.begun, state.peak, state.ceiling
    for i, x in enumerate(values, first):
        noise = sum(ring) / len(ring) if ring else state.seed
        if not open_ or held > s.longest:
            ring.append(x)
            if len(ring) > s.window:
                del ring[0]
        level = float(20 * np.log10(max(x / max(noise, FLOOR), FLOOR))) if x > noise else -120.0
        ceiling = level if ceiling == -np.inf else decayed(level, ceiling, s.edg)
        if not open_ and level >= s.threshold and level >= ceiling:
            open_, begun = True, i
        if open_:
            held += 1
            if level > best:
                peak, best = i, level
            if level < s.threshold:
                spans.append((begun, i, peak, best))
                open_, held, best, begun, peak = False, 0, -120.0, 0, 0
    return spans, State(ring, state.seed, ceiling, open_, held, begun, peak, best)


def trigger_spans(df: DataFrame, keys: list[str], order: list[str], value: str, s: Settings = Settings()) -> DataFrame:
    """(keys, start, stop, peak, level): places (from 0) of the opening, the closing and the highest value of each trigger over a series, and its dB over the floor."""
    cut = chunks(df, keys, order, value).select(*keys, "part", "seq", "start", F.col(value).alias("values"))
    kind = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), f"part int, seq bigint, entry binary, leaves binary, spans array<struct<{SPAN}>>"])
    spans_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("peak", pa.int64()), ("level", pa.float64())]))

    def work(batches):
        for batch in batches:
            entry, leaves, spans = [], [], []
            for start, values, known, tail in zip(*(batch.column(c).to_pylist() for c in ("start", "values", "entry", "tail"))):
                state = State.unpacked(known) if known is not None else None
                if state is None and start:
                    _, state = run(None, start - len(tail), tail, s)  # a guess
                entry.append(state.packed() if state else b"")
                found, state = run(state, start, values, s)
                leaves.append(state.packed())
                spans.append([dict(zip(("start", "stop", "peak", "level"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "part", "seq")), pa.array(entry, pa.binary()), pa.array(leaves, pa.binary()), pa.array(spans, spans_of)], [*keys, "part", "seq", "entry", "leaves", "spans"])

    # by key alone windows see a row a chunk: its state, or the last few values
    along = Window.partitionBy(*keys).orderBy("part", "seq")
    tails = cut.select(*keys, "part", "seq", F.expr(f"slice(values, greatest(size(values) - {4 * s.window}, 0) + 1, {4 * s.window})").alias("tail"))
    tails = tails.withColumn("tail", F.lag("tail").over(along)).filter("tail is not null").select("part", "seq", "tail")
    guessed = cut.join(tails, ["part", "seq"], "left").withColumn("entry", F.lit(None).cast("binary")).withColumn("tail", F.coalesce("tail", F.array().cast("array<double>")))
    done = stored(guessed.mapInArrow(work, schema), "triggers")
    while True:
        before = done.select(*keys, "part", "seq", "entry", "leaves").withColumn("before", F.lag("leaves").over(along))
        wrong = stored(before.filter("before is not null and before != entry").select("part", "seq", F.col("before").alias("entry")), "wrong")
        if not wrong.limit(1).count():
            break
        again = cut.join(wrong, ["part", "seq"]).withColumn("tail", F.array().cast("array<double>")).mapInArrow(work, schema)
        done = stored(done.join(wrong.select("part", "seq"), ["part", "seq"], "left_anti").select(*again.columns).unionByName(again), "triggers")
    return done.select(*keys, F.explode("spans").alias("_s")).select(*keys, "_s.start", "_s.stop", "_s.peak", "_s.level")
