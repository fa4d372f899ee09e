"""The detectors' own kernels over columns of frames: array operations on all frames of an Arrow batch that are equally long."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import detector, tracks


def over_frames(df: DataFrame, key: str, column: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, column): kernel over the rows of a matrix of frames; null arrays stay null, empty ones empty."""
    def run(batches):
        for batch in batches:
            frames = batch.column(column)
            at, flat, null = frames.offsets.to_numpy(), frames.flatten().to_numpy(zero_copy_only=False), ~frames.is_valid().to_numpy(zero_copy_only=False)
            size, start = np.where(null, 0, np.diff(at)), at[:-1] - at[0]
            out: list = [None if gone else np.zeros(0) for gone in null]
            for n in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == n)
                for k, values in zip(rows.tolist(), np.asarray(kernel(flat[start[rows][:, None] + np.arange(n)].astype(float)), dtype=float)):
                    out[k] = values
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.float64()))], [key, column])

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {column} array<double>")


smooth, up_sample = tracks.smooth, tracks.up_sample


def track_event(freq: list[float], amp: list[float], harmonic: list[float], start: int, end: int, signal: float, noise: float, spectrum: np.ndarray) -> detector.Event:
    """An event from its tracks, as the detector would have grown it."""
    return detector.Event(start=start, end=end, noise=noise, signal=signal, amp_peak=max(amp, default=0.0), spectrum=np.asarray(spectrum, dtype=float), amp=list(amp), freq=list(freq), harmonic=list(harmonic))
