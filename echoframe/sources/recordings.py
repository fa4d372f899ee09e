"""Recordings as DataFrames: files of any store that Spark reads, one row a recording (or a triggered segment)."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guano import DOUBLES, INTS, guano_text, parse_guano
from .mp3 import mp3_header
from .wac import read_wac
from .wav import read_wav, write_wav
from .zc import read_zc

RECORDING = (
    "recording_id string, path string, filename string, format string, sample_rate int, bit_depth int, channels int, time_exp double, n_samples bigint, "
    "segment_idx int, trigger_sample bigint, recorded_at string, left array<int>, right array<int>, guano map<string,string>"
)
ZC_FILE = "path string, filename string, metadata map<string,string>, guano map<string,string>, dots array<struct<idx:int,time_us:bigint,freq_hz:double,status:int>>, content binary"
KINDS = {"wav": "wav", "wac": "wac", "mp3": "mp3"}


def file_format(path: Column) -> Column:
    """wav, wac, mp3 or zc by the end of the name (also NN#), else null."""
    name = F.lower(path)
    return F.when(name.rlike(r"\.(wav|wac|mp3)$"), F.regexp_extract(name, r"\.(\w+)$", 1)).when(name.rlike(r"(zc|[0-9]{2}#)$"), "zc")


def wac_time(filename: Column) -> Column:
    """The time in names that end in _YYYYMMDD_HHMMSS (with or without $), as a timestamp."""
    return F.try_to_timestamp(F.regexp_extract(F.regexp_replace(filename, r"\$", ""), r"(\d{8}_\d{6})\.[^.]*$", 1), F.lit("yyyyMMdd_HHmmss"))


def guano_timestamp(text: Column) -> Column:
    """Z: UTC; with an offset: as it says; else local to the session. Fractions of seconds are dropped."""
    plain = F.regexp_replace(text, r"\.\d+", "")
    return F.when(text.isNull() | (text == ""), None).otherwise(F.try_to_timestamp(plain))


def segment_name(name: str, number: int, seconds: float) -> dict:
    """filename and recorded_at of a segment that starts so many seconds into a WAC file.

    A name that ends in _YYYYMMDD_HHMMSS (with or without $) gives the time: the segment's
    own, to the millisecond, stands in its place.  Other names get the number of the segment.
    """
    stem = name.rpartition(".")[0].replace("$", "")
    try:
        when = datetime.strptime(stem[-15:], "%Y%m%d_%H%M%S") + timedelta(milliseconds=int(seconds * 1000 + 1e-6))
    except ValueError:
        return dict(filename=f"{stem}_{number}.wav", recorded_at=None)
    at = f"{when:%Y%m%d_%H%M%S}_{when.microsecond // 1000:03d}"
    return dict(filename=f"{stem[:-15]}{at}.wav", recorded_at=at)


def decode(path: str, raw: bytes, time_exp: float = 1, start: float | None = None, stop: float | None = None, mp3=None) -> list[dict]:
    """Rows of a file; mp3 gives (rate, bit depth, left, right or None) of MP3 bytes, for which this package has no decoder."""
    name = os.path.basename(path)
    kind = name.lower().rpartition(".")[2]
    common = dict(path=path, filename=name, format=kind, time_exp=float(time_exp), recorded_at=None, guano={}, segment_idx=0, trigger_sample=0)
    if kind == "wav":
        w = read_wav(raw, start, stop, time_exp)
        parts = [common | {k: w[k] for k in ("sample_rate", "bit_depth", "channels", "left", "right")} | {"guano": parse_guano(guano_text(raw))}]
    elif kind == "wac":
        w = read_wac(raw)
        common |= dict(sample_rate=int(w["sample_rate"] * time_exp), bit_depth=16, channels=w["channels"])
        parts = [common | segment_name(name, k, at / (w["sample_rate"] * time_exp)) | dict(segment_idx=k, trigger_sample=at, left=left, right=right) for k, (at, left, right) in enumerate(w["segments"])]
    elif kind == "mp3":
        if mp3 is None:
            h = mp3_header(raw)
            raise ValueError(f"{name} ({h['sample_rate']} Hz, {h['channels']} channels): MP3 needs a decoder, and none is given (mp3=)")
        rate, bits, left, right = mp3(raw)
        left, right = np.asarray(left, dtype=np.int32), None if right is None else np.asarray(right, dtype=np.int32)
        parts = [common | dict(sample_rate=int(rate * time_exp), bit_depth=bits, channels=1 if right is None else 2, left=left, right=right)]
    else:
        raise ValueError(f"{name}: the file type must be wav, wac or mp3")
    for p in parts:
        p |= dict(recording_id=f"{path}#{p['segment_idx']}", n_samples=len(p["left"]), left=p["left"], right=np.zeros(0, np.int32) if p["right"] is None else p["right"])
    return parts


def read_audio(spark: SparkSession, path: str | list[str], time_exp: float = 1, start: float | None = None, stop: float | None = None, mp3=None) -> DataFrame:
    """Recordings of WAV and WAC files, and of MP3 files where a decoder is given (see decode); start and stop in seconds (WAV only).

    Samples go to Spark as arrays of their type, without a Python object each.  Filters on path and filename that are applied to the result's path column before
    decoding belong in `path` (globs), as Spark can't push them below the decoder.
    """
    if start is not None and stop is not None and start > stop:
        raise ValueError("start must not be after stop")
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for p, raw in zip(batch.path, batch.content):
                rows = decode(p, raw, time_exp, start, stop, mp3)
                if rows:
                    yield pd.DataFrame(rows)[[c.split()[0] for c in RECORDING.split(", ")]]

    return files.mapInPandas(run, RECORDING)


def read_zero_crossings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a zero-crossing file; explode dots with zc_dots()."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for p, raw in zip(batch.path, batch.content):
                z = read_zc(raw)
                dots = [dict(idx=k, time_us=t, freq_hz=None if f is None else float(f), status=s) for k, (t, f, s) in enumerate(zip(z["time_us"], z["freq_hz"], z["status"]))]
                rows.append(dict(path=p, filename=os.path.basename(p), metadata={k: None if v is None else str(v) for k, v in z["metadata"].items()}, guano=z["guano"], dots=dots, content=raw))
            yield pd.DataFrame(rows)

    return files.mapInPandas(run, ZC_FILE)


def zc_dots(zc: DataFrame) -> DataFrame:
    """One row a dot."""
    return zc.select("path", F.explode("dots").alias("d")).select("path", "d.*")


def zc_frequency(dots: DataFrame, ratio: Column) -> DataFrame:
    """freq_hz again from time_us, with built-in functions: the gap to the dot before the last one."""
    from pyspark.sql import Window

    gap = F.col("time_us") - F.lag("time_us", 2).over(Window.partitionBy("path").orderBy("idx"))
    ok = gap.between(F.greatest(F.lit(48), ratio * 4), F.least(F.lit(12859), ratio * 250))
    return dots.withColumn("freq_hz", F.when(ok, F.floor(ratio * 1000000 / gap).cast("double")))


def zc_display(dots: DataFrame, LPF: float = 125000, HPF: float = 16000, tlim: tuple[float, float] = (0, float("inf"))) -> DataFrame:
    """Dots as a zero-crossing picture shows them: those from LPF up or HPF down lose their frequency; times in seconds, cut to tlim."""
    seconds = F.col("time_us") / 1e6
    shown = dots.withColumn("freq_hz", F.when((F.col("freq_hz") < LPF) & (F.col("freq_hz") > HPF), F.col("freq_hz")))
    return shown.withColumn("seconds", seconds).filter((F.col("seconds") >= float(tlim[0])) & (F.col("seconds") <= float(tlim[1])))


def parsed_guano(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, guano): a map for each GUANO text."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "guano": [parse_guano(t) for t in batch[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, guano map<string,string>")


def guano_columns(df: DataFrame) -> DataFrame:
    """df with a column for each typed GUANO key, named as the key, from its map `guano`."""
    kinds = {**dict.fromkeys(DOUBLES, "double"), **dict.fromkeys(INTS, "int"), "Loc Position Lat": "double", "Loc Position Lon": "double"}
    value = lambda k: F.col("guano").getItem(k)
    return df.select("*", *[value(k).try_cast(t).alias(k) for k, t in kinds.items()], guano_timestamp(value("Timestamp")).alias("Timestamp"))


def metadata(df: DataFrame) -> DataFrame:
    """Metadata of recordings (GUANO, rate, depth) or of zero-crossing files (header, GUANO)."""
    if "metadata" in df.columns:
        return df.select("path", "filename", "metadata", "guano")
    return guano_columns(df.select("path", "filename", "sample_rate", "bit_depth", "guano"))


def wav_bytes(recordings: DataFrame) -> DataFrame:
    """(recording_id, filename, content): each recording as the bytes of a WAV file."""
    def run(batches):
        for batch in batches:
            content = [write_wav(left, int(rate), right if channels > 1 else None, int(bits)) for left, right, rate, channels, bits in zip(batch.left, batch.right, batch.sample_rate, batch.channels, batch.bit_depth)]
            yield pd.DataFrame(dict(recording_id=batch.recording_id, filename=batch.filename, content=content))

    return recordings.select("recording_id", "filename", "sample_rate", "channels", "bit_depth", "left", "right").mapInPandas(run, "recording_id string, filename string, content binary")


def mp3_to_wav(spark: SparkSession, path: str | list[str], mp3) -> DataFrame:
    """(recording_id, filename, content): MP3 files as the bytes of WAV files; the sources stay. Write them with format("wav") of datasource, or as they are."""
    out = wav_bytes(read_audio(spark, path, mp3=mp3))
    return out.withColumn("filename", F.regexp_replace("filename", r"(?i)\.mp3$", ".wav"))
