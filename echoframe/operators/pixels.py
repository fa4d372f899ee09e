"""Regions of a spectrogram of any length: connected pixels, labelled strip by strip.

Frames are dealt to strips of a fixed number of frames, and each strip is labelled by
itself: dark pixels of a frame form runs, runs that touch in neighbouring frames (also
diagonally) are joined.  Pixels on the two borders of a strip then link its regions to those
of the next one; components of these links, few and narrow, say which regions are one, and
what is known of them is added up.  A region is named by its first pixel, by frame and bin.

Defined results: a frame without values (null or empty) has no pixels; frames whose numbers
differ by more than 1 don't touch; equal rows count once, and of several rows of one frame
each bin's largest value counts; an empty table has no regions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Bins of a frame are below this, so a pixel is one number: frame * BINS + bin.
BINS = 1 << 16
STRIP = 4096


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one that links (a, b) lead to."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != (up := root[root])).any():
            root = up


def touching(frame: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs, sorted by frame and low, that touch in neighbouring frames."""
    before = (frame - 1) * BINS
    first = np.searchsorted(frame * BINS + high, before + np.maximum(low - 1, 0))
    last = np.searchsorted(frame * BINS + low, before + np.minimum(high + 1, BINS - 1), side="right")
    count = np.maximum(last - first, 0)
    later = np.repeat(np.arange(len(frame)), count)
    return np.arange(len(later)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count), later


def strip_regions(frame: np.ndarray, values: list[np.ndarray], threshold: float) -> dict[str, np.ndarray]:
    """Regions of the frames of a strip; arrays by region (first, pixels, total, last_frame, low, high), and by run its frame, bounds and region."""
    size = np.array([len(v) for v in values], dtype=np.int64)
    if size.max(initial=0) >= BINS:
        raise ValueError(f"frames must have fewer than {BINS} bins")
    flat = np.concatenate([np.zeros(0), *values])
    place = np.repeat(frame, size) * BINS + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    dark = np.flatnonzero(flat >= threshold)
    order = dark[np.lexsort((-flat[dark], place[dark]))]
    order = order[np.append(True, place[order][1:] != place[order][:-1])] if len(order) else order
    place, x = place[order], flat[order]
    start = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (place[1:] % BINS == 0))) if len(place) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(place))[: len(start)]
    of, low = place[start] // BINS, place[start] % BINS
    high = low + (end - start) - 1
    root = linked(len(start), *touching(of, low, high))
    names, region = np.unique(root, return_inverse=True)
    total = np.append(0.0, np.cumsum(x))
    by = lambda f, v, base: (out := np.full(len(names), base), f.at(out, region, v))[0]
    top = np.iinfo(np.int64)
    return dict(
        first=place[start][names], pixels=by(np.add, end - start, 0), total=by(np.add, total[end] - total[start], 0.0), last_frame=by(np.maximum, of, top.min), low=by(np.minimum, low, top.max), high=by(np.maximum, high, top.min),
        run_frame=of, run_low=low, run_high=high, run_region=region,
    )


def _components(links: DataFrame) -> DataFrame:
    """(recording_id, region, label): of links (recording_id, a, b) the smallest region that each leads to; labels jump to their label's label, so chains of strips halve each round."""
    both = stored(links.select("recording_id", F.col("a").alias("region"), F.col("b").alias("other")).union(links.select("recording_id", "b", "a")).distinct(), "links")
    same = F.col("x.recording_id").eqNullSafe(F.col("y.recording_id"))
    labels = stored(both.groupBy("recording_id", "region").agg(F.least("region", F.min("other")).alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.filter("moved").limit(1).count():
        known = labels.select("recording_id", F.col("region").alias("other"), F.col("label").alias("near"))
        near = both.alias("x").join(known.alias("y"), same & (F.col("x.other") == F.col("y.other"))).groupBy("x.recording_id", "x.region").agg(F.min("near").alias("near"))
        step = labels.alias("x").join(near.alias("y"), same & (F.col("x.region") == F.col("y.region"))).select("x.recording_id", "x.region", "label", F.least("label", "near").alias("next"))
        jump = step.alias("x").join(known.alias("y"), same & (F.col("x.next") == F.col("y.other")), "left").select("x.recording_id", "x.region", "label", F.least("next", F.coalesce(F.col("y.near"), F.col("next"))).alias("next"))
        labels = stored(jump.select("recording_id", "region", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "labels")
    return labels.drop("moved")


def pixel_regions(frames: DataFrame, threshold: float = 1e-5, strip: int = STRIP) -> DataFrame:
    """(recording_id, region, pixels, total, first_frame, last_frame, low, high) of the regions of values of threshold and more.

    frames: recording_id, frame_idx, mag. region numbers the first pixel: its frame times
    BINS plus its bin, so ordering by it is ordering by first pixel.
    """
    kind = frames.schema["recording_id"].dataType.simpleString()
    dealt = frames.select("recording_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("mag").cast("array<double>").alias("mag")).distinct().withColumn("strip", F.floor(F.col("frame_idx") / strip).cast("long"))
    run = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def label(group: pa.Table) -> pa.Table:
        number = group.column("frame_idx").to_numpy()
        order = np.argsort(number, kind="stable")
        column = group.column("mag").combine_chunks().to_pylist()
        r = strip_regions(number[order], [np.array([v for v in column[k] or () if v is not None], dtype=float) for k in order], threshold)
        n, own = len(r["first"]), int(group.column("strip")[0].as_py())
        borders = {}
        for name, at in (("left", own * strip), ("right", own * strip + strip - 1)):
            borders[name] = [[] for _ in range(n)]
            for k in np.flatnonzero(r["run_frame"] == at):
                borders[name][r["run_region"][k]].append(dict(low=int(r["run_low"][k]), high=int(r["run_high"][k])))
        return pa.table(
            [pa.array([group.column("recording_id")[0].as_py()] * n, group.schema.field("recording_id").type), pa.array(np.full(n, own)), *(pa.array(r[c]) for c in ("first", "pixels", "total", "last_frame", "low", "high")), *(pa.array(borders[b], run) for b in ("left", "right"))],
            names=["recording_id", "strip", "region", "pixels", "total", "last_frame", "low", "high", "left", "right"],
        )

    runs = "array<struct<low: bigint, high: bigint>>"
    found = stored(dealt.groupBy("recording_id", "strip").applyInArrow(label, f"recording_id {kind}, strip bigint, region bigint, pixels bigint, total double, last_frame bigint, low bigint, high bigint, left {runs}, right {runs}"), "regions")

    def border(side: str, spread: int) -> DataFrame:
        """(recording_id, strip, region, bin) of the pixels on a border of a strip, and up to `spread` bins beside them."""
        bins = found.select("recording_id", "strip", "region", F.explode(side).alias("r"))
        return bins.select("recording_id", "strip", "region", F.explode(F.sequence(F.col("r.low") - spread, F.col("r.high") + spread)).alias("bin"))

    right, left = border("right", 1).withColumn("strip", F.col("strip") + 1).alias("x"), border("left", 0).alias("y")
    touch = F.col("x.recording_id").eqNullSafe(F.col("y.recording_id")) & (F.col("x.strip") == F.col("y.strip")) & (F.col("x.bin") == F.col("y.bin"))
    links = right.join(left, touch).select("x.recording_id", F.col("x.region").alias("a"), F.col("y.region").alias("b"))
    labels = _components(links).alias("y")
    named = found.alias("x").join(labels, F.col("x.recording_id").eqNullSafe(F.col("y.recording_id")) & (F.col("x.region") == F.col("y.region")), "left")
    whole = named.groupBy("x.recording_id", F.coalesce("y.label", "x.region").alias("region")).agg(F.sum("pixels").alias("pixels"), F.sum("total").alias("total"), F.max("last_frame").alias("last_frame"), F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.select("recording_id", "region", "pixels", "total", F.floor(F.col("region") / BINS).alias("first_frame"), "last_frame", "low", "high")
