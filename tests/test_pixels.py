"""Regions labelled in strips against flood fill and against the textbook labeller."""

import numpy as np
import pytest

from echoframe.functions import regions
from echoframe.operators import pixels


def flood(p, threshold):
    """(region, pixels, total, last_frame, low, high) of a picture of frames by bins, by search from pixel to pixel."""
    todo, out = {(f, b) for f, b in zip(*np.nonzero(p >= threshold))}, []
    for first in sorted(todo):
        if first not in todo:
            continue
        todo.remove(first)
        stack, own = [first], []
        while stack:
            f, b = stack.pop()
            own.append((f, b))
            for near in [(f + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if near in todo:
                    todo.remove(near)
                    stack.append(near)
        fs, bs = zip(*own)
        out.append((min(own)[0] * pixels.BINS + min(own)[1], len(own), round(sum(p[x] for x in own), 6), max(fs), min(bs), max(bs)))
    return sorted(out)


def own(spark, pictures, threshold, strip):
    rows = [(k, f, [float(v) for v in row], "clash") for k, p in pictures.items() for f, row in enumerate(p)]
    d = spark.createDataFrame(rows, "recording_id string, frame_idx bigint, mag array<double>, region string").repartition(5)
    return pixels.pixel_regions(d, threshold, strip)


@pytest.mark.parametrize("strip", [1, 4, 16, 4096])
def test_regions_equal_flood_fill(spark, strip):
    rng = np.random.default_rng(6)
    pictures = {"a": rng.random((60, 24)), "b": rng.random((37, 9)), None: rng.random((20, 5)), "c": np.zeros((10, 4)), "d": np.ones((30, 3))}
    for threshold in (0.62, 0.8):
        got = own(spark, pictures, threshold, strip).collect()
        want = [(str(k), *r) for k, p in pictures.items() for r in flood(p, threshold)]
        assert sorted((str(r.recording_id), r.region, r.pixels, round(r.total, 6), r.last_frame, r.low, r.high) for r in got) == sorted(want)
        assert all(r.first_frame == r.region // pixels.BINS for r in got)


def test_a_spiral_across_many_strips(spark):
    """Two arms that meet in the last strip only are one region."""
    p = np.zeros((100, 7))
    p[:, 1] = p[:, 5] = 1
    p[99, 1:6] = 1
    p[3, 3] = 1
    got = own(spark, {"x": p}, 0.5, 8).orderBy("region").collect()
    assert [(r.pixels, r.first_frame, r.last_frame) for r in got] == [(203, 0, 99), (1, 3, 3)]


def test_regions_are_those_of_the_textbook_labeller(spark):
    rng = np.random.default_rng(7)
    p = np.pad(rng.random((48, 20)), 1)
    p[p < 0.7] = 0
    labels = regions.Labeller(p.T, "textbook")
    want = [(r.first, labels.pixels_of(r)) for r in labels.run()]
    got = own(spark, {"x": p}, regions.WHITE, 7).orderBy("region").collect()
    assert [(r.first_frame * p.shape[1] + r.region % pixels.BINS, r.pixels) for r in got] == want


def test_edges(spark):
    d = spark.createDataFrame([("a", 0, None), ("a", 1, []), ("a", 2, [1.0, None]), ("a", 2, [1.0, None]), ("a", 2, [0.5, 2.0, 3.0]), ("a", 4, [1.0])], "recording_id string, frame_idx int, mag array<double>")
    got = pixels.pixel_regions(d, 1.0, 2).orderBy("region").collect()
    assert [(r.region // pixels.BINS, r.region % pixels.BINS, r.pixels, r.total) for r in got] == [(2, 0, 3, 6.0), (4, 0, 1, 1.0)]
    assert pixels.pixel_regions(d.limit(0)).count() == 0


def test_links():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (50, 30), (500, 480), (300, 900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        got, want = pixels.linked(n, a, b), np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
            if (got == want).all():
                break
        assert (got == want).all()
    chain = np.random.default_rng(9).permutation(100_000)
    assert (pixels.linked(100_000, chain[:-1], chain[1:]) == 0).all()
