"""Kernels against closed forms and slow independent loops."""

import math

import numpy as np
import pytest

from echoframe.functions import detector, regions, spectra, tracks


def tone(bin_, n=256, phase=0.3):
    return 1000 * np.sin(2 * np.pi * bin_ * np.arange(n) / n + phase)


@pytest.mark.parametrize("name", ["hann", "blackman4", "blackman7"])
def test_textbook_magnitude_of_a_tone(name):
    m = spectra.magnitudes(tone(20), np.array([0]), 256, spectra.window(name, 256), "textbook")[0]
    assert m.argmax() == 20
    assert abs(m[20] - 500) < 5


def test_reference_pairs_other_bins():
    x, w = np.random.default_rng(0).normal(size=64), spectra.window("hann", 64)
    a = spectra.magnitudes(x, np.array([0]), 64, w, "reference")[0]
    k = np.arange(64)
    re = [sum(x * w * np.cos(2 * np.pi * b * k / 64)) for b in range(33)]
    im = [sum(x * w * np.sin(2 * np.pi * b * k / 64)) for b in range(33)]
    expected = [math.hypot(re[b], im[b + 1] if b < 31 else re[32]) / w.sum() for b in range(32)]
    assert np.allclose(a, expected)
    assert not np.allclose(a, spectra.magnitudes(x, np.array([0]), 64, w, "textbook")[0])


def test_frames_outside_the_signal_are_zero():
    f = spectra.frames_at(np.arange(1, 5), np.array([-2, 3, 100, -50]), 4)
    assert f.tolist() == [[0, 0, 1, 2], [4, 0, 0, 0], [0] * 4, [0] * 4]


def test_unknown_window_and_bad_overlap():
    with pytest.raises(ValueError):
        spectra.window("flat", 8)
    with pytest.raises(ValueError):
        spectra.hop(256, 1.0)


def test_spectrogram_frames():
    assert spectra.spectrogram(np.ones(1000), 256, 0.875).shape == (math.ceil(1000 / 32), 128)
    assert spectra.spectrogram(np.ones(0), 256).shape == (0, 128)


def test_kernel_mask_is_one_bin_off_in_the_reference():
    x = np.ones(40)
    assert tracks.kernel_mask(20, x).argmax() == 21
    assert tracks.kernel_mask(20, x, "textbook").argmax() == 20
    assert np.isclose(tracks.kernel_mask(20, x).sum(), 1)


def test_kalman_gain_tends_to_the_golden_ratio():
    k = tracks.Kalman(1e-5, 1e-5, 0.0)
    for _ in range(50):
        k.next(1.0)
    gain = (k.error + k.q) / (k.error + k.q + k.r)
    assert abs(gain - (math.sqrt(5) - 1) / 2) < 1e-9


def test_line_and_samples():
    y = np.arange(10) * 2.0 + 1
    assert np.allclose(tracks.line_fit(y), y)
    assert tracks.value_at(y, 0.5) == pytest.approx(10.0)
    assert tracks.value_at(np.array([3.0]), 0.7) == 3.0
    assert np.allclose(tracks.up_sample(y, 19), np.arange(19) + 1)
    assert tracks.clock(3661.2345) == "01:01:01.234"


def test_region_labels_of_known_shapes():
    def visits(mask, compat="reference"):
        return [r.visits for r in regions.Labeller(np.pad(mask.astype(float), 2), compat).run()]

    solid = np.ones((5, 5))
    assert visits(solid) == [26]
    assert visits(np.ones((1, 5))) == [9]
    assert visits(np.ones((1, 1))) == [1]
    hole = solid.copy()
    hole[2, 2] = 0
    assert len(visits(hole)) == 2 and len(visits(hole, "textbook")) == 1
    ring = np.ones((7, 7))
    ring[2:5, 2:5] = 0
    assert len(visits(ring)) == 4 and len(visits(ring, "textbook")) == 1
    thin = np.ones((7, 7))
    thin[1:6, 1:6] = 0
    assert len(visits(thin)) == 1


def components(mask):
    left, n = {(y, x) for y, x in zip(*np.nonzero(mask))}, 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            y, x = todo.pop()
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
    return n


def test_textbook_labels_are_components():
    rng = np.random.default_rng(1)
    for _ in range(150):
        m = rng.random((14, 16)) < rng.uniform(0.2, 0.7)
        inner = m.copy()
        inner[0] = inner[-1] = inner[:, 0] = inner[:, -1] = False
        assert len(regions.Labeller(m.astype(float), "textbook").run()) == components(inner)


def test_image_operators_against_loops():
    p = np.random.default_rng(2).random((12, 9)) * 5
    mean, out = np.zeros(12), p.copy()
    for x in range(1, 9):
        for y in range(12):
            z = p[y, x] - 0.5 * mean[y]
            out[y, x] = max(z, 0)
            mean[y] += (z - mean[y]) / x
    assert np.allclose(regions.background_subtract(p, 0.5), out)
    b = regions.contrast_boost(p, 2)
    q = p.copy()
    q[:3] = q[-3:] = 0
    for x in range(9):
        for y in range(3, 9):
            rest = q[:, x].sum() - sum(q[y + k, x] for k in range(-3, 4))
            assert b[y, x] == pytest.approx(max(q[y, x] - rest * 2 / 5, 0))


def test_gini_moments_quantiles():
    assert regions.gini(np.ones(8)) == pytest.approx(1 - 1 / 8)
    assert regions.gini(np.zeros(8)) == 1
    c, sd, skew, _ = regions.moments(np.array([1.0, 2, 3, 2, 1]), 1.0)
    assert c == pytest.approx(3) and skew == pytest.approx(0) and sd == pytest.approx(math.sqrt(12 / 9))
    assert regions.quantile_bins(np.array([1.0, 1, 1, 1]), (0.25, 0.5, 1.0)).tolist() == [0, 1, 3]


def chirps(rate=250000, count=6, gap=0.1, length=0.008):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 20, int(rate * (gap * count + 0.1)))
    t = np.arange(int(length * rate)) / rate
    wave = 8000 * np.hanning(len(t)) * np.sin(2 * np.pi * (60000 * t - 20000 / length * t * t / 2))
    for k in range(count):
        a = int((0.05 + gap * k) * rate)
        x[a : a + len(t)] += wave
    return x.astype(int), rate


def test_detector_finds_chirps():
    x, rate = chirps()
    s = detector.Settings(LPF=rate / 2, compat="textbook")
    events = detector.detect(x, rate, s)
    assert len(events) == 6
    f = detector.extract(events[2], rate, s)
    assert 35000 < f["freq_min"] < f["freq_max"] < 65000
    assert f["freq_start"] > f["freq_end"]
    assert set(detector.FEATURES) <= set(f)


def test_reference_detector_triggers_on_each_chirp():
    x, rate = chirps()
    peaks = detector.find_peaks(x, rate, detector.Settings(LPF=rate / 2))
    assert len(peaks) == 6
    assert all(abs(p / rate - (0.054 + 0.1 * k)) < 0.006 for k, (p, _) in enumerate(peaks))


def test_nothing_in_silent_and_short_input():
    s = detector.Settings(LPF=24000, HPF=1000)
    assert detector.detect(np.zeros(5000, dtype=int), 48000, s) == []
    assert detector.detect(np.ones(100, dtype=int), 48000, s) == []
    assert regions.detect(np.zeros(0, dtype=int), 48000, regions.Settings(LPF=24000, HPF=1000)) == []
    assert regions.detect(np.zeros(5000, dtype=int), 48000, regions.Settings(LPF=24000, HPF=1000)) == []


def test_regions_find_chirps():
    x, rate = chirps()
    found = regions.detect(x, rate, regions.Settings(LPF=rate / 2))
    assert len(found) == 6
    assert all(25000 < f["freq_centroid"] + 16000 < 70000 for f in found)


def test_noise_floor_is_a_moving_mean():
    values = np.random.default_rng(3).random((30, 4))
    floor = detector.NoiseFloor(values[0], 5)
    for k, v in enumerate(values):
        floor.add(v)
        assert np.allclose(floor.mean, values[max(0, k - 4) : k + 1].mean(axis=0))


def test_region_features_in_both_readings():
    x, rate = chirps(count=2)
    a = regions.detect(x, rate, regions.Settings(LPF=rate / 2))
    b = regions.detect(x, rate, regions.Settings(LPF=rate / 2, compat="textbook"))
    assert all(35000 < f["quant_50"] < 65000 for f in b) and all(abs(f["freq_skew"]) < 20 for f in b)
    assert max(abs(f["freq_kurtosis"]) for f in a) > 20
    solid = np.pad(np.ones((5, 5)), 2)
    labels = regions.Labeller(solid)
    assert [(r.visits, labels.pixels_of(r)) for r in labels.run()] == [(26, 25)]


def busy(n):
    """A recording whose picture is dark in two fifths of its pixels, with holes and regions in them."""
    return np.random.default_rng(5).normal(0, 100, n).astype(int)


BUSY = dict(HPF=200, LPF=8000, min_dur=1, max_dur=1e6, min_area=5, FFT_size=64, bg_substract=1, contrast_boost=1)


@pytest.mark.parametrize("compat", ["reference", "textbook"])
def test_regions_of_parts_are_those_of_the_whole_picture(monkeypatch, compat):
    x, s = busy(16000), regions.Settings(**BUSY, compat=compat)
    p = spectra.spectrogram(x, 64, 0.875, "blackman4", 0, 31, compat).T[::-1]
    p = regions.contrast_boost(regions.post_mask(regions.background_subtract(regions.blur(p, s.blur), s.bg_substract), s.EDG), s.contrast_boost)
    whole = regions.Labeller(p, compat)
    want = [(r.first, r.last, r.visits, r.magnitude, whole.pixels_of(r)) for r in whole.run()]
    for block in (64, 333, 1999, 10**6):  # 1999: the last of the 2,000 frames would be alone
        monkeypatch.setattr(regions, "BLOCK", block)
        got = []
        for first, part in regions.pictures(x, s, 0, 31):
            labels, before = regions.Labeller(part, compat), (first - 1) * len(part)
            got += [(before + r.first, before + r.last, r.visits, r.magnitude, labels.pixels_of(r)) for r in labels.run()]
        assert got == want and len(want) > 300


def test_memory_of_regions_is_not_that_of_the_recording(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(regions, "BLOCK", 128, raising=False)
    s, peak = regions.Settings(**BUSY), []
    for n in (8000, 64000):
        x = busy(n) * (np.arange(n) // 2000 % 2)  # every second stretch is silent
        tracemalloc.start()
        for _ in getattr(regions, "found", regions.detect)(x, 16000, s):
            pass
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 3 * peak[0], peak  # eight times the samples
