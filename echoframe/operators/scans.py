"""Recurrences over series of any length, as scans: many tasks work on one series.

A recurrence whose step is y -> max(m, a y + b) needs no loop: such steps compose to steps of
the same form.  A series is cut into chunks (a stretch of it within one sorted range of the
table and one Arrow batch).  Every chunk is reduced to one step; the steps of a series'
chunks, few and narrow, are composed in order and give each chunk the state in which it
begins; then every chunk is worked out.  Composition within a chunk doubles its reach
each time (log2 n array operations for n elements), for all chunks of a batch at once.

Shape: one range shuffle of (keys, order, value), written once; what is joined back is a row a
chunk, and only of series of several chunks.  Order columns must tell the elements of a
series apart: rows that tie in all of them come in any order, and lie in one range.

Defined results: null values are left out; an empty table gives an empty result; a series of
one element has its start only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

Maps = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Recurrence:
    """steps(i, x): (a, b, m) of y -> max(m, a y + b) for elements x at places i; the step at place 0 doesn't depend on y (a = 0).

    out(x, before, y): what is put out for elements, the states before them and their own.
    """

    steps: Callable[[np.ndarray, np.ndarray], Maps]
    out: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = lambda x, before, y: y


def kalman(q: float, r: float) -> Recurrence:
    """The scalar filter that starts without error at the first value: its gains depend on the place only, and soon on nothing."""
    gains, error = [0.0], 0.0
    while len(gains) < 100_000:
        gain = (error + q) / (error + q + r)
        if gain == gains[-1]:
            break
        error = (1 - gain) * (error + q)
        gains.append(gain)
    gains = np.array(gains)

    def steps(i, x):
        g = gains[np.minimum(i, len(gains) - 1)]
        return np.where(i == 0, 0.0, 1 - g), np.where(i == 0, x, g * x), np.full(len(x), -np.inf)

    return Recurrence(steps)


def smoothing(gain: float) -> Recurrence:
    """One-pole smoothing in the order of the series."""
    return Recurrence(lambda i, x: (np.where(i == 0, 0.0, gain), np.where(i == 0, x, (1 - gain) * x), np.full(len(x), -np.inf)))


def decaying_maximum(edg: float) -> Recurrence:
    """A maximum that decays towards the values; the first value starts it."""
    return Recurrence(lambda i, x: (np.where(i == 0, 0.0, edg), np.where(i == 0, x, (1 - edg) * x), np.where(i == 0, -np.inf, x)))


def post_mask(edg: float) -> Recurrence:
    """Values whose double is below a decaying maximum that starts at 0 become 0."""
    return Recurrence(lambda i, x: (np.where(i == 0, 0.0, edg), (1 - edg) * x, x), lambda x, before, y: np.where(2 * x < y, 0.0, x))


def background_subtract(factor: float) -> Recurrence:
    """Values less factor times the running mean of what was left before, at least 0; the first stays."""

    def steps(i, x):
        k = np.maximum(i, 1)
        return np.where(i == 0, 0.0, 1 - (1 + factor) / k), np.where(i == 0, 0.0, x / k), np.full(len(x), -np.inf)

    return Recurrence(steps, lambda x, before, y: np.where(np.isnan(before), x, np.maximum(x - factor * before, 0)))


def composed(steps: Maps, first: np.ndarray) -> Maps:
    """For each element the composition of the steps from the start of its segment (place first) up to it."""
    a, b, m = (np.array(v, dtype=float) for v in steps)
    reach, longest = 1, int((np.arange(len(a)) - first).max(initial=0)) + 1
    while reach < longest:
        at = np.flatnonzero(np.arange(len(a)) - reach >= first)
        early = at - reach
        with np.errstate(invalid="ignore"):
            carried = np.where(np.isneginf(m[early]), -np.inf, a[at] * m[early] + b[at])
        a2, b2, m2 = a[at] * a[early], a[at] * b[early] + b[at], np.maximum(m[at], carried)
        a[at], b[at], m[at] = a2, b2, m2
        reach *= 2
    return a, b, m


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's start."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def chunks(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, part, seq, n, order columns, value): stretches of series in order of part and seq, with arrays of order and value."""
    columns = [*keys, *order, value]
    rows = df.select(*keys, *order, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    ranges = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order).sortWithinPartitions(*keys, *order)

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            at = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, batch.column(c)) for c in (*order, value)]
            heads = [batch.column(k).take(pa.array(starts)) for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(np.full(len(starts), part, np.int32)), pa.array(seq + np.arange(len(starts))), pa.array(np.diff(np.append(starts, batch.num_rows)).astype(np.int64)), *lists], [*keys, "part", "seq", "n", *order, value])
            seq += len(starts)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "part int, seq bigint, n bigint", *(f"`{c}` array<{kind[c]}>" for c in columns[len(keys) :])])
    packed = stored(ranges.mapInArrow(pack, schema), "chunks")
    # places of the first elements: sums over a row a chunk
    before = Window.partitionBy(*keys).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    places = packed.select(*keys, "part", "seq", "n").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("pieces", F.count("*").over(Window.partitionBy(*keys)))
    several = places.filter("pieces > 1").select("part", "seq", "start", F.lit(True).alias("several"))
    return packed.join(several, ["part", "seq"], "left").withColumn("start", F.coalesce("start", F.lit(0))).withColumn("several", F.coalesce("several", F.lit(False)))


def scan(df: DataFrame, keys: list[str], order: list[str], value: str, recurrence: Recurrence) -> DataFrame:
    """(keys, order, i, value): the recurrence over each series of values, i its places from 0."""
    cut = chunks(df, keys, order, value)

    def prefixes(batch):
        x, at = _flat(batch.column(value))
        size = np.diff(at)
        first = np.repeat(at[:-1], size)
        i = np.arange(len(x)) - first + np.repeat(batch.column("start").to_numpy(), size)
        return x, at, i, composed(recurrence.steps(i, x), first)

    def summed(batches):
        for batch in batches:
            _, at, _, steps = prefixes(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "part", "seq")), *(pa.array(s[at[1:] - 1]) for s in steps)], [*keys, "part", "seq", "a", "b", "m"])

    def entered(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("seq", "ascending")])
        a, b, m = composed(tuple(group.column(c).to_numpy() for c in "abm"), np.zeros(group.num_rows, np.int64))
        return pa.table({"part": group.column("part"), "seq": group.column("seq"), "entry": np.append(0.0, np.maximum(m, b)[:-1])})

    kind = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    key_kinds = [f"`{k}` {kind[k]}" for k in keys]
    sums = cut.filter("several").select(*keys, "part", "seq", "start", value).mapInArrow(summed, ", ".join([*key_kinds, "part int, seq bigint, a double, b double, m double"]))
    entries = sums.groupBy(*keys).applyInArrow(entered, "part int, seq bigint, entry double")

    def worked(batches):
        for batch in batches:
            x, at, i, (a, b, m) = prefixes(batch)
            size = np.diff(at)
            entry = np.repeat(batch.column("entry").to_numpy(zero_copy_only=False), size)
            y = np.maximum(m, a * entry + b)
            before = np.append(np.nan, y)[: len(y)]
            heads = at[:-1][size > 0]
            before[heads] = np.where(i[heads] == 0, np.nan, entry[heads])
            lists = pa.array(at.astype(np.int32))
            out = recurrence.out(x, before, y)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(batch.column(c) for c in order), batch.column("start"), pa.ListArray.from_arrays(lists, pa.array(out))], [*keys, *order, "start", value])

    schema = ", ".join([*key_kinds, *(f"`{c}` {kind[c]}" for c in order), "start bigint", f"`{value}` array<double>"])
    done = cut.join(entries, ["part", "seq"], "left").withColumn("entry", F.coalesce("entry", F.lit(0.0))).select(*keys, *order, "start", "entry", value).mapInArrow(worked, schema)
    cells = F.explode(F.arrays_zip(*order, value, F.sequence(F.lit(0), F.size(value) - 1).alias("place")))
    return done.select(*keys, "start", cells.alias("_c")).select(*keys, *(F.col(f"_c.{c}").alias(c) for c in order), (F.col("start") + F.col("_c.place")).alias("i"), F.col(f"_c.{value}").alias(value))
