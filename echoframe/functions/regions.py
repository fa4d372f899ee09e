"""Image-style region detector for one channel of one recording (numpy, no Spark)."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .spectra import hop, magnitudes, window
from .tracks import clock

FEATURES = (
    "starting_time", "duration", "area", "freq_centroid", "freq_bandwith", "freq_skew", "freq_kurtosis", "q", "freq_gini", "quant_2.5", "quant_25", "quant_50", "quant_75", "quant_97.5",
    "freq_bw_95_ci", "freq_bw_75_ci", "temp_centroid", "temp_bandwith", "temp_skew", "temp_kurtosis", "temp_gini", "grad_centroid", "grad_bandwith", "grad_skew", "grad_kurtosis", "grad_gini",
)
WHITE = 1e-5
EPSILON = np.finfo(float).eps
REACH = 8
#: Frames that are worked on together.
BLOCK = 8192


@dataclass(frozen=True)
class Settings:
    """Detector parameters (bat preset)."""

    min_dur: float = 1.5
    max_dur: float = 80
    min_area: int = 40
    min_TBE: float = 20
    max_TBE: float = 1000
    EDG: float = 0.9
    LPF: float | None = None
    HPF: float = 16000
    FFT_size: int = 256
    FFT_overlap: float = 0.875
    blur: float = 2
    bg_substract: float = 20
    contrast_boost: float = 20
    compat: str = "reference"


def blur(p: np.ndarray, factor: float) -> np.ndarray:
    """Each inner row: factor times itself plus its neighbours above and below."""
    out = p.copy()
    out[1:-1] = factor * p[1:-1] + p[:-2] + p[2:]
    return out


class Past:
    """What the columns so far leave to those that follow: their number, the running mean, the decaying maximum."""

    def __init__(self, height: int):
        self.columns, self.mean, self.level = 0, np.zeros(height), np.zeros(height)


def background_subtract(p: np.ndarray, factor: float, past: Past | None = None) -> np.ndarray:
    """From the second column on: minus factor times the running mean of what was left, at least 0."""
    past = past or Past(len(p))
    out, mean, before = p.copy(), past.mean, past.columns
    for x in range(0 if before else 1, p.shape[1]):
        z = p[:, x] - factor * mean
        out[:, x] = np.maximum(z, 0)
        mean = mean + (z - mean) / (before + x)
    past.mean, past.columns = mean, before + p.shape[1]
    return out


def post_mask(p: np.ndarray, edg: float, past: Past | None = None) -> np.ndarray:
    """Zero where twice the value is below a slowly decaying maximum."""
    past = past or Past(len(p))
    out, level = p.copy(), past.level
    for x in range(p.shape[1]):
        z = p[:, x]
        level = np.maximum(z, edg * level + (1 - edg) * z)
        out[:, x] = np.where(2 * z < level, 0, z)
    past.level = level
    return out


def contrast_boost(p: np.ndarray, boost: float) -> np.ndarray:
    """Minus a share of the rest of the column outside a neighbourhood of seven rows; three edge rows are white."""
    out, h = p.copy(), len(p)
    out[:3] = out[-3:] = 0
    if h <= 7:
        return out
    near = sum(out[3 + k : h - 3 + k] for k in range(-3, 4))
    out[3:-3] = np.maximum(out[3:-3] - (out.sum(axis=0) - near) * (boost / (h - 7)), 0)
    return out


@dataclass
class Region:
    """A labelled region; offsets count down the columns, `visits` are contour visits plus inner pixels."""

    number: int
    visits: int = 0
    magnitude: float = 0.0
    first: int = 2**31 - 1
    last: int = 0


class Labeller:
    """Contour-tracing labels of the pixels that aren't white.

    compat='reference' starts inner contours in direction 3, which leaves the borders
    of some holes untraced; 'textbook' starts them in direction 1.
    """

    UNSET, MARKED = 0, -1

    def __init__(self, p: np.ndarray, compat: str = "reference"):
        p = p.copy()
        p[0] = p[-1] = 0
        p[:, 0] = p[:, -1] = 0
        self.pixels = p
        self.height, self.width = p.shape
        # arrays, as lists take several times the memory
        self.value = array("d", np.asarray(p.T, dtype=float).tobytes())
        self.dark = (p.T >= WHITE).tobytes()
        self.label = array("i", bytes(4 * p.size))
        h = self.height
        # Neighbours from the one below, counter-clockwise, and the directions in which contours start (linear-time
        # component labelling by contour tracing; Chang, Chen and Lu, 2004).
        self.around = (1, h + 1, h, h - 1, -1, -h - 1, -h, -h + 1)
        self.inner_start = 3 if compat == "reference" else 1
        self.regions: dict[int, Region] = {}

    def visit(self, at: int, number: int) -> None:
        self.label[at] = number
        r = self.regions.setdefault(number, Region(number))
        r.visits += 1
        r.magnitude += self.value[at]
        r.first, r.last = min(r.first, at), max(r.last, at)

    def look(self, at: int, start: int) -> tuple[int, int]:
        """The next dark pixel around `at` and its direction; white ones on the way are marked."""
        for k in range(8):
            direction = (start + k) % 8
            to = at + self.around[direction]
            if 0 <= to < len(self.value):
                if self.dark[to]:
                    return to, direction
                self.label[to] = self.MARKED
        return at, -1

    def trace(self, start: int, number: int, outer: bool) -> None:
        second, direction = self.look(start, 7 if outer else self.inner_start)
        self.visit(start, number)
        if second == start:
            return
        here = second
        while True:
            self.visit(here, number)
            to, direction = self.look(here, (direction + 5) % 8)
            if here == start and to == second:
                return
            here = to

    def run(self) -> list[Region]:
        """All regions, by their first pixel."""
        h, number = self.height, 0
        for y, x in zip(*(a.tolist() for a in np.nonzero(self.pixels[1:-1] >= WHITE))):
            at = x * h + y + 1
            if not self.dark[at - 1] and self.label[at] == self.UNSET:
                number += 1
                self.trace(at, number, True)
            if not self.dark[at + 1] and self.label[at + 1] == self.UNSET:
                self.trace(at, self.label[at] if self.label[at] != self.UNSET else self.label[at - 1], False)
            if self.label[at] == self.UNSET:
                self.visit(at, self.label[at - 1])
        return sorted(self.regions.values(), key=lambda r: r.first)

    def pixels_of(self, r: Region) -> int:
        """Pixels with a region's label."""
        a, b = r.first // self.height, r.last // self.height + 1
        return self.label[a * self.height : b * self.height].count(r.number)

    def segment(self, r: Region) -> np.ndarray:
        """The columns of a region with its own pixels only."""
        a, b = r.first // self.height, r.last // self.height + 1
        own = np.array(self.label[a * self.height : b * self.height]).reshape(b - a, self.height).T == r.number
        return np.where(own, self.pixels[:, a:b], 0)


def moments(x: np.ndarray, scale: float) -> tuple[float, float, float, float]:
    """Weighted centroid (from 1), deviation, skewness and excess kurtosis, all times scale."""
    w = x / max(x.sum(), EPSILON)
    at = np.arange(1, len(x) + 1)
    middle = (w * at).sum()
    d = at - middle
    sd = np.sqrt((w * d**2).sum())
    skew, tail = ((w * d**3).sum() / sd**3, (w * d**4).sum() / sd**4 - 3) if sd > EPSILON else (0.0, 0.0)
    return middle * scale, sd * scale, skew * scale, tail * scale


def gini(x: np.ndarray) -> float:
    """1 minus the sum of squared shares; 1 if empty."""
    total = x.sum()
    return float(1 - ((x / total) ** 2).sum()) if total > EPSILON else 1.0


def quantile_bins(x: np.ndarray, shares=(0.025, 0.25, 0.5, 0.75, 0.975)) -> np.ndarray:
    """First bins where the running sum reaches each share, of a spectrum or of the rows of many."""
    run = np.cumsum(x, axis=-1)
    return np.stack([np.argmax(run >= q * run[..., -1:], axis=-1) for q in shares], axis=-1)


def features(segment: np.ndarray, sample_rate: int, size: int, compat: str = "reference", low: int = 0) -> dict[str, float]:
    """Shape features of a segment (row 0 is the highest frequency).

    compat='reference' counts frequencies from the lowest row, starting at 1, and scales
    skewness and kurtosis, too, by the Hz of a bin; 'textbook' adds the lowest bin `low`
    and leaves those two without a unit.
    """
    low_first = segment[::-1]
    h, w = low_first.shape
    envelope = low_first.sum(axis=0)
    power, jumps, area, before = np.zeros(h), np.zeros(2 * h), 0, 0
    for x in range(w):
        peak = 0
        if envelope[x] > EPSILON:
            s = low_first[:, x].copy()
            top = int(s.argmax())
            s[top + REACH + 1 :] = 0
            if top > REACH:
                s[1 : top - REACH] = 0
            inner = s[1:-1]
            power[1:-1] += inner
            area += int((inner > WHITE).sum())
            total = inner.sum()
            peak = int(np.floor((inner * np.arange(1, h - 1)).sum() / total + 0.5)) if total > 0 else 0
            if peak > 0 and before > 0:
                k = peak - before + h
                for shift in (-1, 0, 1):
                    if 0 <= peak + shift < h and 0 <= k + shift < 2 * h:
                        jumps[k + shift] += s[peak + shift]
        before = peak
    scale = sample_rate / size
    out: dict[str, float] = {"area": float(area)}
    for name, x in (("freq", power), ("temp", envelope), ("grad", jumps)):
        for k, v in zip(("centroid", "bandwith", "skew", "kurtosis"), moments(x, scale)):
            out[f"{name}_{k}"] = float(v)
        out[f"{name}_gini"] = gini(x)
    out["q"] = out["freq_centroid"] / max(out["freq_bandwith"] / scale, 1.0)
    bins = [float(b * scale) for b in quantile_bins(power)]
    out |= dict(zip(("quant_2.5", "quant_25", "quant_50", "quant_75", "quant_97.5"), bins))
    out |= {"freq_bw_95_ci": bins[4] - bins[0], "freq_bw_75_ci": bins[3] - bins[1]}
    if compat == "textbook":
        out |= {k: v / scale for k, v in out.items() if k.endswith(("_skew", "_kurtosis"))}
        out |= {k: v + low * scale for k, v in out.items() if k.startswith("quant_")}
        out["freq_centroid"] += (low - 1) * scale
    return out


def pictures(samples: np.ndarray, s: Settings, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, picture): the filtered picture of a recording, in parts that no region crosses, each with a white column on either side.

    A part ends at the last place of a block of frames where no dark pixel touches one of
    the next column.  Tracing marks white pixels only around a region and reads marks only
    below its own pixels, of which those outside it are marked by its own outer contour
    first; so parts have the labels of the whole picture.  What is held at once is a block
    and the frames since the last such place.
    """
    size, step = s.FFT_size, hop(s.FFT_size, s.FFT_overlap)
    seeks, win = np.arange(0, len(samples), step), window("blackman4", size)
    edges = [*range(0, len(seeks), BLOCK), len(seeks)]
    if len(edges) > 2 and edges[-1] - edges[-2] == 1:
        del edges[-2]  # the sums of a column alone are rounded otherwise
    past, first, held, border = Past(high - low + 1), 0, [], np.zeros((high - low + 1, 1), dtype=bool)
    for a, b in zip(edges, edges[1:]):
        own = samples[seeks[a] : seeks[b - 1] + size]
        p = magnitudes(own, seeks[a:b] - seeks[a], size, win, s.compat)[:, low : high + 1].T[::-1]
        p = contrast_boost(post_mask(background_subtract(blur(p, s.blur), s.bg_substract, past), s.EDG, past), s.contrast_boost)
        p[0] = p[-1] = 0
        if a == 0:
            p[:, 0] = 0
        if b == len(seeks):
            p[:, -1] = 0
        dark = np.concatenate([border, p >= WHITE], axis=1)
        near = dark[:, 1:].copy()
        near[1:] |= dark[:-1, 1:]
        near[:-1] |= dark[1:, 1:]
        cuts = np.flatnonzero(~(near & dark[:, :-1]).any(axis=0))
        border = dark[:, -1:]
        if len(cuts):
            k = int(cuts[-1])
            held.append(p[:, :k])
            yield first, np.pad(np.concatenate(held, axis=1), ((0, 0), (1, 1)))
            first, held = a + k, [p[:, k:].copy()]
        else:
            held.append(p)
    yield first, np.pad(np.concatenate(held, axis=1), ((0, 0), (1, 1)))


def found(samples: np.ndarray, sample_rate: int, s: Settings) -> Iterator[dict]:
    """Regions that pass the area and duration filters, with features, before the spacing filter; one after the other, by their first pixel."""
    size, step = s.FFT_size, hop(s.FFT_size, s.FFT_overlap)
    low = int(int(s.HPF) * size / sample_rate)
    high = int(np.ceil(int(s.LPF) * size / sample_rate)) - 1
    if high - low < 3 or len(samples) == 0:
        return
    for frame, p in pictures(samples, s, low, high):
        labels = Labeller(p, s.compat)
        before, at = (frame - 1) * len(p), step / (len(p) * sample_rate)
        for r in labels.run():
            if (r.visits if s.compat == "reference" else labels.pixels_of(r)) <= s.min_area:
                continue
            segment = labels.segment(r)
            duration = segment.shape[1] * step / sample_rate * 1000
            if s.min_dur <= duration <= s.max_dur:
                first, last = (before + r.first) * at, (before + r.last) * at
                yield {"starting_time": clock(first), "duration": duration, "first": first, "last": last, **features(segment, sample_rate, size, s.compat, low)}


def detect(samples: np.ndarray, sample_rate: int, s: Settings) -> list[dict]:
    """All that found() gives."""
    return list(found(samples, sample_rate, s))
