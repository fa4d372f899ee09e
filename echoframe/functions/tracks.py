"""Recursions and shape features of tracks (numpy, no Spark)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Binomial kernel of order 12, times 4096.
KERNEL = np.array([1, 12, 66, 220, 495, 792, 924, 792, 495, 220, 66, 12, 1]) / 4096


def smooth(x: np.ndarray, gain: float = 0.25) -> np.ndarray:
    """One-pole smoothing, backward, then forward, of a spectrum or of the rows of many."""
    return np.asarray(x, dtype=float) @ _smoothing(np.shape(x)[-1], gain)


@lru_cache(maxsize=32)
def _smoothing(n: int, gain: float) -> np.ndarray:
    """The weights of smooth(): it is linear, so its rows are the smoothed unit vectors."""
    out = np.eye(n)
    for k in range(n - 2, -1, -1):
        out[:, k] = (1 - gain) * out[:, k] + gain * out[:, k + 1]
    for k in range(1, n):
        out[:, k] = (1 - gain) * out[:, k] + gain * out[:, k - 1]
    return out


def kernel_mask(peak: int, x: np.ndarray, compat: str = "reference") -> np.ndarray:
    """x weighted by the kernel around the peak; the reference centres it one bin higher."""
    out = np.zeros_like(x)
    first = peak - len(KERNEL) // 2 + (1 if compat == "reference" else 0)
    a, b = max(first, 0), min(first + len(KERNEL), len(x))
    if a < b:
        out[a:b] = x[a:b] * KERNEL[a - first : b - first]
    return out


def centroid(x: np.ndarray) -> float:
    total = x.sum()
    return float((np.arange(len(x)) * x).sum() / total) if total else 0.0


class Kalman:
    """Scalar Kalman filter with process noise q and measurement noise r."""

    def __init__(self, q: float, r: float, state: float, error: float = 1.0):
        self.q, self.r, self.state, self.error = q, r, state, error

    def next(self, z: float) -> float:
        predicted = self.error + self.q
        gain = predicted / (predicted + self.r)
        self.error = (1 - gain) * predicted
        self.state += gain * (z - self.state)
        return self.state


def kalman_track(values, q: float, r: float) -> np.ndarray:
    """Filtered values; the first is the seed and starts without error."""
    values = [float(v) for v in values]
    k = Kalman(q, r, values[0], 0.0)
    return np.array([k.state, *(k.next(v) for v in values[1:])])


def turn(track: list[float]) -> float:
    """Degrees between the last two steps; 0 with fewer than three points."""
    if len(track) < 3:
        return 0.0
    l, m, r = track[-3:]  # noqa: E741
    return float(abs(np.degrees(np.arctan(r - m) - np.arctan(m - l))))


def decayed(level: float, ceiling: float, edg: float) -> float:
    """The next value of a maximum that decays exponentially towards the level."""
    return max(level, edg * ceiling + (1 - edg) * level)


def decaying_maximum(x, edg: float) -> np.ndarray:
    """decayed() over a series; the first value starts it."""
    out = []
    for v in np.asarray(x, dtype=float).tolist():
        out.append(decayed(v, out[-1], edg) if out else v)
    return np.array(out)


def _lagrange() -> np.ndarray:
    """Powers 0 to 3 of the place between the inner two of four neighbours -> their weights: the cubic that goes through all four."""
    return np.linalg.inv(np.vander([-1.0, 0.0, 1.0, 2.0], increasing=True)).T


_CUBIC = _lagrange()


def interpolation(size: int, shares) -> np.ndarray:
    """Weights of a track of `size` values at shares of its length: cubic inside, linear at the edges; one row a share."""
    shares = np.clip(np.asarray(shares, dtype=float), 0, 1) * (size - 1)
    left = shares.astype(int)
    part = shares - left
    out = np.zeros((len(shares), size))
    rows = np.arange(len(shares))
    inside = (left > 0) & (left < size - 2)
    weights = (part[:, None] ** np.arange(4)) @ _CUBIC.T
    for k in range(4):
        out[rows[inside], left[inside] + k - 1] = weights[inside, k]
    edge = ~inside
    out[rows[edge], left[edge]] = 1 - part[edge]
    out[rows[edge], np.minimum(left[edge] + 1, size - 1)] += np.where(left[edge] + 1 < size, part[edge], 0)
    return out


def value_at(x: np.ndarray, share: float) -> float:
    """A track's value at a share of its length."""
    return float((interpolation(len(x), [share]) @ x)[0])


def up_sample(x: np.ndarray, size: int) -> np.ndarray:
    """A track (or the rows of many) stretched to `size` values."""
    x = np.asarray(x, dtype=float)
    return x @ interpolation(x.shape[-1], np.arange(size) / (size - 1)).T


def quad_peak(x: np.ndarray, i: int) -> float:
    """Parabolic peak position; 0 below bin 3 or at the last bin."""
    if i < 3 or i + 1 >= len(x):
        return 0.0
    return float(i + (x[i + 1] - x[i - 1]) / (2 * (2 * x[i] - x[i - 1] - x[i + 1])))


def line_fit(y: np.ndarray) -> np.ndarray:
    """Least-squares line over 0, 1, 2, ...; a single point fits itself."""
    n = len(y)
    if n < 2:
        return y.astype(float)
    x = np.arange(n) - (n - 1) / 2
    return y.mean() + x * (x * y).sum() / (x * x).sum()


def clock(seconds: float) -> str:
    """HH:MM:SS.mmm, truncated."""
    ms = int(seconds * 1000 + 1e-9)
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
