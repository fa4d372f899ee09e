"""Short-time spectra of recordings, parallel also within one long recording."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectra
from .events import channel as channel_of
from .storage import stored

FRAMES = "recording_id string, frame_idx bigint, seek bigint, mag array<double>"


def chunks(recordings: DataFrame, size: int, hop: int, channel: str = "left", frames: int = 8192) -> DataFrame:
    """Pieces of `frames` hops with a halo of size - hop samples, one row each; the tail is short."""
    step = frames * hop
    samples = recordings.select("recording_id", "sample_rate", channel_of(channel).alias("s")).filter(F.size("s") > 0)
    index = samples.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / step).cast("int"))))
    return index.select("recording_id", "sample_rate", "chunk", (F.col("chunk") * step).cast("long").alias("offset"), F.slice("s", F.col("chunk") * step + 1, F.lit(step + max(size - hop, 0))).alias("samples"), F.least(F.lit(step), F.size("s") - F.col("chunk") * step).alias("own"))


def time_slice(recordings: DataFrame, tlim: tuple[float, float]) -> DataFrame:
    """Recordings cut to tlim seconds: from sample max(1, floor(from * rate)) to min(n, ceil(to * rate)), counted from 1, both included."""
    a = F.greatest(F.lit(1), F.floor(F.lit(float(tlim[0])) * F.col("sample_rate"))).cast("int")
    n = F.greatest(F.lit(0), F.least(F.size("left"), F.ceil(F.lit(float(tlim[1])) * F.col("sample_rate"))) - a + 1).cast("int")
    return recordings.withColumn("right", F.when(F.size("right") > 0, F.slice("right", a, n)).otherwise(F.col("right"))).withColumn("left", F.slice("left", a, n))


def fspec(recordings: DataFrame, channel: str = "left", FFT_size: int = 256, FFT_overlap: float = 0.875, FFT_win: str = "hann", LPF: float | None = None, HPF: float = 0, tlim: tuple | None = None, flim: tuple | None = None, to_dB: bool = True, compat: str = "reference") -> DataFrame:
    """(recording_id, frame_idx, seek, mag): a frame every hop, bins from HPF to LPF (or flim), in ascending frequency."""
    if tlim is not None and len(tlim) != 2 or flim is not None and len(flim) != 2:
        raise ValueError("tlim and flim need two values")
    spectra.window(FFT_win, 4)
    low_hz, high_hz = flim if flim is not None else (HPF, LPF)
    if tlim is not None:
        recordings = time_slice(recordings, tlim)
    step = spectra.hop(FFT_size, FFT_overlap)

    def run(batches):
        win = spectra.window(FFT_win, FFT_size)
        for batch in batches:
            for i, rate, offset, samples, own in zip(batch.recording_id, batch.sample_rate, batch.offset, batch.samples, batch.own):
                low, high = spectra.bin_range(rate, FFT_size, low_hz or 0, high_hz)
                seeks = np.arange(0, own, step)
                m = spectra.magnitudes(np.asarray(samples), seeks, FFT_size, win, compat)[:, low : high + 1]
                m = np.maximum(spectra.to_db_ref(m), -6000.0) if to_dB else m
                yield pd.DataFrame(dict(recording_id=i, frame_idx=(offset + seeks) // step, seek=offset + seeks, mag=list(m)))

    # chunks of one recording go to different tasks
    return chunks(recordings, FFT_size, step, channel).repartition("recording_id", "chunk").mapInPandas(run, FRAMES)


def spectro(recordings: DataFrame, floor: float = -120.0, **parameters) -> DataFrame:
    """fspec with a hann window, against each recording's maximum, not below floor: ready to draw."""
    # written once, as its largest value is needed before it; one number a recording, so no task holds all frames of one
    f = stored(fspec(recordings, **(parameters | {"FFT_win": "hann", "to_dB": True})), "spectra")
    most = f.groupBy("recording_id").agg(F.max(F.array_max("mag")).alias("_most"))
    return f.join(most, "recording_id").withColumn("mag", F.transform("mag", lambda x: F.greatest(x - F.col("_most"), F.lit(floor)))).drop("_most")


def without_background(frames: DataFrame, floor: float = -120.0) -> DataFrame:
    """Bins below the mean plus one standard deviation of their recording's bins are set to the floor."""
    limit = frames.select("recording_id", F.explode("mag").alias("v")).groupBy("recording_id").agg((F.avg("v") + F.stddev_samp("v")).alias("_limit"))
    return frames.join(limit, "recording_id").withColumn("mag", F.transform("mag", lambda x: F.when(x < F.col("_limit"), floor).otherwise(x))).drop("_limit")


def rotated(frames: DataFrame, width: int = 1024) -> DataFrame:
    """(recording_id, part, row, values): the picture turned by a quarter: a row a bin, the highest first, over time; in parts of at most `width` frames."""
    long = frames.select("recording_id", "frame_idx", F.size("mag").alias("bins"), F.posexplode("mag").alias("bin", "v"))
    part = F.floor(F.col("frame_idx") / width)
    cells = long.groupBy("recording_id", part.alias("part"), (F.col("bins") - 1 - F.col("bin")).cast("long").alias("row")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "v"))).alias("cells"))
    return cells.select("recording_id", "part", "row", F.col("cells.v").alias("values"))
