"""Operators as table functions for SQL: their schema follows from the table and the arguments, and they ask for partitioning and order themselves.

    SELECT * FROM spaced(TABLE(events), keys => 'recording_id', start => 'event_start', stop => 'event_end', low => 20, high => 1000)
    SELECT * FROM spectral_frames(TABLE(recordings), size => 256, overlap => 0.875, win => 'blackman7', compat => 'reference')

Arguments are constants.  A table without one of the named columns is an error when the
statement is analysed.  Null starts and ends are of no spacing: such rows are kept and pair
with none; null or empty samples have no frames; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import spectra


def _constants(table: AnalyzeArgument, columns: list[AnalyzeArgument], *others: AnalyzeArgument) -> None:
    """The first argument must be a table with the columns that the next ones name; all but it must be constants."""
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    if any(a.value is None for a in (*columns, *others)):
        raise ValueError("all arguments but the table must be constants")
    missing = [c for a in columns for c in a.value.split(",") if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {missing[0]}")


class Spaced:
    """Rows without both members of each pair of neighbours less than low or more than high apart."""

    def __init__(self):
        self.held, self.bad, self.end = None, False, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, start: AnalyzeArgument, stop: AnalyzeArgument, low: AnalyzeArgument, high: AnalyzeArgument) -> AnalyzeResult:
        _constants(rows, [keys, start, stop], low, high)
        return AnalyzeResult(rows.dataType, partitionBy=[PartitioningColumn(k) for k in keys.value.split(",")], orderBy=[OrderingColumn(start.value), OrderingColumn(stop.value)])

    def eval(self, rows, keys, start, stop, low, high):
        a, gap = rows[start], None
        if a is not None and self.end is not None:
            gap = a - self.end
        bad = gap is not None and not float(low) <= gap <= float(high)
        if self.held is not None and not (self.bad or bad):
            yield self.held
        self.held, self.bad, self.end = tuple(rows), bad, rows[stop]

    def terminate(self):
        if self.held is not None and not self.bad:
            yield self.held


class SpectralFrames:
    """The columns of a row other than its samples, with frame_idx, seek and mag of every frame of them."""

    @staticmethod
    def _kept(kind: StructType) -> list[StructField]:
        return [f for f in kind.fields if f.name not in ("left", "right")]

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, win: AnalyzeArgument, compat: AnalyzeArgument) -> AnalyzeResult:
        _constants(rows, [], size, overlap, win, compat)
        spectra.window(win.value, 4)
        spectra.hop(int(size.value), float(overlap.value))
        if "left" not in rows.dataType.names:
            raise ValueError("the table has no column left")
        more = [StructField("frame_idx", LongType()), StructField("seek", LongType()), StructField("mag", ArrayType(DoubleType()))]
        return AnalyzeResult(StructType([*SpectralFrames._kept(rows.dataType), *more]))

    def eval(self, rows, size, overlap, win, compat):
        samples, size = np.asarray(rows["left"] or (), dtype=float), int(size)
        kept = tuple(v for c, v in zip(rows.__fields__, rows) if c not in ("left", "right"))
        step = spectra.hop(size, float(overlap))
        seeks = np.arange(0, len(samples), step)
        for a in range(0, len(seeks), 1024):  # a long recording's spectra are never held whole
            for k, m in enumerate(spectra.magnitudes(samples, seeks[a : a + 1024], size, spectra.window(win, size), compat), a):
                yield (*kept, k, int(seeks[k]), m.tolist())


def register(spark: SparkSession) -> None:
    """Makes spaced and spectral_frames known to SQL."""
    spark.udtf.register("spaced", udtf(Spaced))
    spark.udtf.register("spectral_frames", udtf(SpectralFrames))
