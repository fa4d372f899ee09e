"""Pictures of spectrograms, events and zero-crossing dots, and reports of events: pictures with an HTML index."""

from __future__ import annotations

import html
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png(grey: np.ndarray) -> bytes:
    """An 8-bit greyscale picture."""
    grey = np.ascontiguousarray(grey, dtype=np.uint8)
    height, width = grey.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), grey], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def spectrogram_png(mag: np.ndarray, floor: float = -120.0) -> bytes:
    """(frames, bins) in decibels against their maximum: dark is loud, high frequencies on top."""
    x = np.clip(np.asarray(mag, dtype=float), floor, 0) / floor
    return png((255 * x).T[::-1]) if x.size else png(np.full((1, 1), 255))


def zc_png(time_us, freq_hz, hpf: float = 16000, lpf: float = 125000, width: int = 800, height: int = 300) -> bytes:
    """Dots between hpf and lpf over time."""
    points = [(t, f) for t, f in zip(time_us, freq_hz) if f is not None and hpf < f < lpf]
    out = np.full((height, width), 255)
    last = max([t for t, _ in points], default=1) or 1
    for t, f in points:
        out[int((lpf - f) / (lpf - hpf) * (height - 1)), int(t / last * (width - 1))] = 0
    return png(out)


def event_pictures(recordings: DataFrame, events: DataFrame, time_scale: float = 0.1, ticks: bool = True, size: int = 256, margin: float = 0.25, HPF: float = 0, LPF: float | None = None) -> DataFrame:
    """(recording_id, event_start, picture): a PNG of each event, made where its recording lies.

    events have recording_id, event_start and event_end (samples, from 1); time_scale is
    milliseconds a pixel; a margin of the event's length is shown on both sides; ticks
    marks its start and end.
    """
    import pandas as pd

    from ..functions.spectra import bin_range, magnitudes, to_db, window

    def picture(samples: np.ndarray, rate: int, first: int, last: int) -> bytes:
        step = max(int(rate * time_scale / 1000), 1)
        more = int((last - first) * margin)
        a, b = max(first - 1 - more, 0), min(last + more, len(samples))
        seeks = np.arange(a, max(b, a + 1), step)
        low, high = bin_range(rate, size, HPF, LPF)
        db = to_db(magnitudes(samples, seeks - size // 2, size, window("hann", size), "textbook")[:, low : high + 1])
        grey = 255 * np.clip((db - db.max()) / -120, 0, 1).T[::-1]
        if ticks:
            for at in (first - 1, last):
                grey[:, min(np.searchsorted(seeks, at), len(seeks) - 1)] = 0
        return png(grey)

    def draw(batches):
        for batch in batches:
            rows = []
            for i, rate, samples, found in zip(batch.recording_id, batch.sample_rate, batch.left, batch.found):
                samples = np.asarray(samples)
                rows += [(i, e["event_start"], picture(samples, int(rate), e["event_start"], e["event_end"])) for e in found]
            yield pd.DataFrame(rows, columns=["recording_id", "event_start", "picture"])

    found = events.groupBy("recording_id").agg(F.collect_list(F.struct("event_start", "event_end")).alias("found"))  # the events of one recording
    return recordings.select("recording_id", "sample_rate", "left").join(found, "recording_id").mapInPandas(draw, "recording_id string, event_start bigint, picture binary")


def event_report(recordings: DataFrame, events: DataFrame, folder: str, columns: list[str], **picture) -> None:
    """A picture of each event, and index.html with these columns of the events by recording and start, in a mounted folder.

    picture: parameters of event_pictures.  One job draws where the recordings lie and
    writes (format "event_report"); nothing is opened.
    """
    from .datasource import register

    register(recordings.sparkSession)
    drawn = event_pictures(recordings, events, **picture)
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells")
    rows = events.select("recording_id", F.col("event_start").cast("long").alias("event_start"), cells).join(drawn, ["recording_id", "event_start"])
    rows.write.format("event_report").option("columns", json.dumps(columns)).mode("overwrite").save(folder)


def index_page(columns: list[str], rows: Iterator[tuple[str, str, list[str]]]) -> Iterator[str]:
    """The lines of the index of (recording, picture's name, cells), which are sorted by recording."""
    yield "<!doctype html><meta charset='utf-8'><title>Events</title>"
    last = None
    for recording, name, cells in rows:
        if recording != last:
            yield ("" if last is None else "</table>") + f"<h2>{html.escape(recording)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}<th></th></tr>"
            last = recording
        yield "<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + f"<td><img src='{name}' loading='lazy'></td></tr>"
    if last is not None:
        yield "</table>"
