"""Short-time spectra of sample arrays (numpy, no Spark).

``compat='reference'`` pairs the real part of a bin with the imaginary part of the
next one (and the last bin with the real Nyquist part), as the detectors' published
thresholds assume; ``'textbook'`` gives the usual magnitude.
"""

from __future__ import annotations

import numpy as np

# Cosine-sum windows (Hann; Blackman-Harris with 4 and 7 terms).
WINDOWS = {
    "hann": (0.5, 0.5),
    "blackman4": (0.35875, 0.48829, 0.14128, 0.01168),
    "blackman7": (0.2712203606, 0.4334446123, 0.21800412, 0.0657853433, 0.0107618673, 0.0007700127, 0.00001368088),
}
FLOOR = 1e-6


def window(name: str, size: int) -> np.ndarray:
    """A symmetric window."""
    terms = WINDOWS.get(name.lower())
    if terms is None:
        raise ValueError(f"this type of window is not implemented: {name}")
    phase = 2 * np.pi * np.arange(size) / max(size - 1, 1)
    return sum((-1) ** k * a * np.cos(k * phase) for k, a in enumerate(terms))


def to_db(x):
    """Decibels with a floor of -120."""
    return 20 * np.log10(np.maximum(x, FLOOR))


def to_db_ref(x, ref: float = 1.0):
    """Decibels against a reference, minus infinity at 0."""
    with np.errstate(divide="ignore"):
        return 20 * np.log10(np.asarray(x, dtype=float) / ref)


def frames_at(samples: np.ndarray, seeks: np.ndarray, size: int) -> np.ndarray:
    """Rows of `size` samples from each position; zeros outside the signal. Only the samples asked for are touched."""
    samples, seeks, n = np.asarray(samples), np.asarray(seeks), len(samples)
    out = np.zeros((len(seeks), size))
    inside = (seeks >= 0) & (seeks + size <= n)
    if inside.any():
        out[inside] = np.lib.stride_tricks.sliding_window_view(samples, size)[seeks[inside]]
    for k in np.flatnonzero(~inside):  # at the two ends
        a, b = max(int(seeks[k]), 0), min(int(seeks[k]) + size, n)
        if a < b:
            out[k, a - seeks[k] : b - seeks[k]] = samples[a:b]
    return out


def magnitudes(samples: np.ndarray, seeks: np.ndarray, size: int, win: np.ndarray, compat: str = "reference") -> np.ndarray:
    """size/2 magnitudes of the windowed frame at each position, divided by the window's sum."""
    half = size // 2
    out = np.empty((len(seeks), half))
    for a in range(0, len(seeks), 4096):
        z = np.fft.rfft(frames_at(samples, seeks[a : a + 4096], size) * win, axis=1)
        if compat == "reference":
            other = z.imag[:, 1 : half + 1].copy()
            other[:, -1] = z.real[:, half]
            out[a : a + 4096] = np.hypot(z.real[:, :half], other)
        else:
            out[a : a + 4096] = np.abs(z[:, :half])
    return out / win.sum()


def hop(size: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("the overlap must be at least 0 and below 1")
    return max(int(size * (1 - overlap)), 1)


def bin_range(sample_rate: float, size: int, hpf: float = 0, lpf: float | None = None) -> tuple[int, int]:
    """First and last bin of a frequency range; an upper limit above Nyquist is that of Nyquist."""
    nyquist = sample_rate / 2
    lpf = nyquist if lpf is None else min(lpf, nyquist)
    low = int(hpf * size / sample_rate)
    high = min(int(np.ceil(lpf * size / sample_rate)), size // 2 - 1)
    return low, max(high, low)


def spectrogram(samples, size: int = 256, overlap: float = 0.875, win: str = "hann", low: int = 0, high: int | None = None, compat: str = "reference") -> np.ndarray:
    """(frames, bins low..high): frames every hop until the samples end, the tail filled with zeros."""
    high = size // 2 - 1 if high is None else high
    seeks = np.arange(0, len(samples), hop(size, overlap))
    return magnitudes(samples, seeks, size, window(win, size), compat)[:, low : high + 1]


def band_pass(spectra: np.ndarray, lpf: float, hpf: float, resolution: float) -> np.ndarray:
    """Zero for bins above lpf or below hpf."""
    k = np.arange(spectra.shape[-1])
    return np.where((k > lpf / resolution) | (k < hpf / resolution), 0.0, spectra)
