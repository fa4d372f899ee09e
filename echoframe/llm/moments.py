"""Sums of small matrices over partitions: a few hundred numbers a partition, added up by the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, parts: Callable[[pa.RecordBatch], dict[int, np.ndarray]], length: int) -> dict[int, np.ndarray]:
    """{class: vector of `length` sums} where parts gives them for one batch.

    Each partition adds up its own batches first, so what is shuffled is a few
    vectors a partition; the driver receives one vector a class.
    """

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in parts(batch).items():
                total[k] = total.get(k, 0) + v
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(length, k, dtype=np.int64)), pa.array(np.arange(length)), pa.array(np.asarray(v, dtype=np.float64))], ["k", "i", "x"])

    out: dict[int, np.ndarray] = {}
    # sums of doubles depend on the order of partitions in their last bits: 1e-9 of relative rounding hides that
    for k, i, x in df.mapInArrow(run, "k long, i long, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(k, np.zeros(length))[i] = float(f"{x:.10g}")
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of float lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def rows(values: np.ndarray) -> pa.Array:
    """Rows as a column of float lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.astype(np.float32).reshape(-1)))
