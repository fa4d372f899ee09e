"""Adaptive signal-to-noise detector for one channel of one recording (numpy, no Spark)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .spectra import FLOOR, band_pass, hop, magnitudes, to_db, window
from .tracks import Kalman, centroid, clock, decayed, kalman_track, kernel_mask, line_fit, quad_peak, smooth, turn, up_sample, value_at

FEATURES = (
    "starting_time", "duration", "freq_max_amp", "freq_max", "freq_min", "bandwidth", "freq_start", "freq_center", "freq_end", "freq_knee", "fc", "freq_bw_knee_fc", "bin_max_amp",
    "pc_freq_max_amp", "pc_freq_max", "pc_freq_min", "pc_knee", "temp_bw_knee_fc", "slope", "kalman_slope", "curve_neg", "curve_pos_start", "curve_pos_end", "mid_offset", "snr", "hd", "smoothness",
)
SILENT = 1e-5
RECENT = 5


@dataclass(frozen=True)
class Settings:
    """Detector parameters (bat preset)."""

    threshold: float = 14
    min_dur: float = 1.5
    max_dur: float = 80
    min_TBE: float = 20
    max_TBE: float = 1000
    EDG: float = 0.996
    LPF: float | None = None
    HPF: float = 16000
    FFT_size: int = 256
    FFT_overlap: float = 0.875
    start_thr: float = 40
    end_thr: float = 20
    SNR_thr: float = 10
    angle_thr: float = 40
    duration_thr: float = 80
    NWS: float = 100
    KPE: float = 1e-5
    KME: float = 1e-5
    compat: str = "reference"


# The preset for thrushes.
THRUSH = dict(threshold=12, min_dur=140, max_dur=440, min_TBE=300, max_TBE=5000, LPF=8000, HPF=2000, start_thr=25, end_thr=30, angle_thr=45, duration_thr=440, NWS=1000, KME=1e-4)


def snr(x: np.ndarray, noise: np.ndarray) -> float:
    """Decibels of signal over noise, over the bins above the noise."""
    above = x > noise
    return float(to_db(x[above].sum() / max(noise[above].sum(), FLOOR)))


def snrs(x: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """snr() of rows."""
    above = x > noise
    return to_db(np.where(above, x, 0).sum(axis=1) / np.maximum(np.where(above, noise, 0).sum(axis=1), FLOOR))


class NoiseFloor:
    """Moving mean of spectra: growing until `length` of them are held, then over the last `length`."""

    def __init__(self, first: np.ndarray, length: int):
        self.mean, self.length, self.ring = first.copy(), length, deque(maxlen=length)

    def add(self, x: np.ndarray) -> None:
        self.mean = self.mean + ((x - self.mean) / (len(self.ring) + 1) if len(self.ring) < self.length else (x - self.ring[0]) / self.length)
        self.ring.append(x)

    def after(self, x: np.ndarray) -> np.ndarray:
        """The means after each of the rows of x, as if each was added; the ring must be full."""
        old = np.concatenate([np.stack(list(self.ring)[: len(x)]), x])[: len(x)]
        return self.mean + np.cumsum((x - old) / self.length, axis=0)

    def add_all(self, x: np.ndarray, mean: np.ndarray) -> None:
        """Rows whose last mean is known."""
        self.ring.extend(x)
        self.mean = mean


class Trigger:
    """The state of the trigger from frame to frame: noise floor (frozen while open), decaying maximum, open or closed."""

    def __init__(self, first: np.ndarray, length: int, threshold: int, edg: float, frame_ms: float, longest_ms: float):
        self.floor, self.noise = NoiseFloor(first, length), first
        self.threshold, self.edg, self.frame_ms, self.longest_ms = threshold, edg, frame_ms, longest_ms
        self.open, self.held, self.best, self.place, self.ceiling = False, 0.0, -120.0, 0, -np.inf

    def step(self, at: int, x: np.ndarray) -> tuple[int, np.ndarray] | None:
        """Takes the next frame; (place of the maximum, noise floor) where the trigger closes."""
        if not self.open or self.held > self.longest_ms:
            self.floor.add(x)
        found = self._level(at, snr(x, self.noise))
        self.noise = self.floor.mean
        return found

    def _level(self, at: int, level: float) -> tuple[int, np.ndarray] | None:
        self.ceiling = level if self.ceiling == -np.inf else decayed(level, self.ceiling, self.edg)
        self.open = self.open or (level >= self.threshold and level >= self.ceiling)
        if not self.open:
            return None
        self.held += self.frame_ms
        if level > self.best:
            self.place, self.best = at, level
        if level >= self.threshold:
            return None
        self.open, self.held, self.best = False, 0.0, -120.0
        return self.place, self.noise

    def quiet(self, x: np.ndarray) -> int:
        """Takes those of the first rows of x that leave a closed trigger with a full ring closed; how many they are."""
        if self.open or len(self.floor.ring) < self.floor.length:
            return 0
        means = self.floor.after(x)
        levels = snrs(x, np.concatenate([self.noise[None, :], means[:-1]])).tolist()
        taken = 0
        for level in levels:
            if level >= self.threshold:  # it may open here
                break
            self.ceiling = level if self.ceiling == -np.inf else decayed(level, self.ceiling, self.edg)
            taken += 1
        if taken:
            self.floor.add_all(x[:taken], means[taken - 1])
            self.noise = self.floor.mean
        return taken


def triggered(spectra: np.ndarray, places: np.ndarray, trigger: Trigger) -> list[tuple[int, np.ndarray]]:
    """(place, noise floor) where the trigger closes; quiet stretches are taken in blocks that grow while it stays closed."""
    peaks, k, block = [], 0, 8
    while k < len(spectra):
        taken = trigger.quiet(spectra[k : k + min(block, trigger.floor.length)])
        if taken:
            block = min(2 * block, 1024)
        else:
            found, taken, block = trigger.step(int(places[k]), spectra[k]), 1, 8
            if found:
                peaks.append(found)
        k += taken
    return peaks


def find_peaks(samples: np.ndarray, sample_rate: int, s: Settings) -> list[tuple[int, np.ndarray]]:
    """(position, noise floor) of each triggered peak.

    Fewer samples than a frame give none; a trigger still open at the end is lost.
    """
    n, size = len(samples), s.FFT_size
    step = size // 2
    length = int(np.float32(s.NWS) * np.float32(sample_rate) / np.float32(1000) / np.float32(step))
    if n < size:
        return []
    if length < 1:
        raise ValueError("the noise window is shorter than one hop")
    total = np.concatenate([[0.0], np.cumsum(np.asarray(samples, dtype=np.float64) ** 2)])
    energy = lambda at: total[np.clip(at + size, 0, n)] - total[np.clip(at, 0, n)]
    starts = np.arange(-step, n, step)
    loud = np.flatnonzero(np.cumsum(energy(starts)) >= SILENT)
    first = int(starts[loud[0]] if len(loud) else starts[-1]) + step
    count = 1 + (n - size) // step
    seeks = first + step * np.arange(count - 1)
    seeks = seeks[seeks <= n]
    seeks = seeks[energy(seeks) >= SILENT]
    resolution = sample_rate / size
    threshold = int(s.threshold)
    spectra = band_pass(magnitudes(samples, np.concatenate([[first], seeks]), size, window("blackman7", size), s.compat), int(s.LPF), int(s.HPF), resolution)
    trigger = Trigger(spectra[0], length, threshold, s.EDG, 1000 * step / sample_rate, s.duration_thr)
    return triggered((spectra[1:] + spectra[:-1]) / 2, np.maximum(seeks - step, 0), trigger)


@dataclass
class Event:
    """Frames of one event, earliest first."""

    start: int = 0
    end: int = 0
    noise: float = 0.0
    signal: float = 0.0
    amp_peak: float = 0.0
    spectrum: np.ndarray | None = None
    amp: deque = field(default_factory=deque)
    freq: deque = field(default_factory=deque)
    harmonic: deque = field(default_factory=deque)

    @property
    def frames(self) -> int:
        return len(self.freq)


@dataclass
class Frame:
    signal: float
    noise: float
    energy: float
    centroid: float
    amp: float
    harmonic: float
    mask: np.ndarray


class Grower:
    """Follows peaks forwards and backwards; frames are analysed ahead, AHEAD of them at a time."""

    AHEAD = 16

    def __init__(self, samples: np.ndarray, sample_rate: int, s: Settings):
        self.samples, self.s = samples, s
        self.step = hop(s.FFT_size, s.FFT_overlap)
        self.window = window("blackman7", s.FFT_size)
        # the reference divides integers here
        self.resolution = sample_rate // s.FFT_size if s.compat == "reference" else sample_rate / s.FFT_size

    def frames(self, seeks: range) -> Iterator[tuple[int, Frame]]:
        """The positions and their analysed frames, one after the other."""
        for a in range(0, len(seeks), self.AHEAD):
            some = seeks[a : a + self.AHEAD]
            x = magnitudes(self.samples, np.array(some), self.s.FFT_size, self.window, self.s.compat)
            x = smooth(band_pass(x, int(self.s.LPF), int(self.s.HPF), self.resolution))
            above = x > self.noise
            signal, noise = np.where(above, x, 0).sum(axis=1), np.where(above, self.noise, 0).sum(axis=1)
            x = np.maximum(x - self.noise, 0)
            for k, (seek, peak) in enumerate(zip(some, x.argmax(axis=1).tolist())):
                mask = kernel_mask(peak, x[k], self.s.compat)
                middle = centroid(mask)
                yield seek, Frame(float(signal[k]), float(noise[k]), float(mask.sum()), middle, float(x[k, peak]), float(x[k, min(int(np.floor(2 * middle + 0.5)), x.shape[1] - 1)]), mask)

    def keep(self, event: Event, f: Frame, front: bool) -> None:
        for track, value in ((event.amp, f.amp), (event.freq, f.centroid), (event.harmonic, f.harmonic)):
            track.appendleft(value) if front else track.append(value)
        event.signal, event.noise, event.amp_peak = event.signal + f.signal, event.noise + f.noise, max(event.amp_peak, f.energy)
        event.spectrum = f.mask.copy() if event.spectrum is None else event.spectrum + f.mask

    def over(self, event: Event, f: Frame, track: deque, recent: deque, kalman: Kalman, drop: float) -> bool:
        """Whether a frame is no longer part of the event."""
        track.append(kalman.next(f.centroid))
        recent.append(float(to_db(f.signal / max(f.noise, FLOOR))))
        fall = float(to_db(event.amp_peak) - to_db(f.energy))
        return fall > drop or turn(list(track)) > self.s.angle_thr or sum(recent) / len(recent) < self.s.SNR_thr

    def grow(self, peak: int, noise: np.ndarray) -> Event:
        """The event around a peak over this noise floor.

        Where a scan runs into the end of the recording the event ends with its last frame
        (or the last sample); at the beginning it starts with its first frame.
        """
        event, s, step, n = Event(), self.s, self.step, len(self.samples)
        self.noise = smooth(noise)
        _, first = _, f = next(self.frames(range(peak, peak + 1)))
        self.keep(event, f, False)
        kalman, track, recent = Kalman(s.KPE, s.KME, f.centroid), deque(maxlen=3), deque(maxlen=RECENT)
        event.end = min(peak + step - 1, n - 1)
        for k, (seek, f) in enumerate(self.frames(range(peak + step, n - step + 1, step))):
            if self.over(event, f, track, recent, kalman, s.end_thr) and k > 1:
                event.end = seek - 1
                break
            self.keep(event, f, False)
            event.end = min(seek + step - 1, n - 1)
        # the reference restarts from the last frame that it looked at
        kalman, track, recent = Kalman(s.KPE, s.KME, f.centroid if s.compat == "reference" else first.centroid), deque(maxlen=3), deque(maxlen=RECENT)
        event.start = peak
        for seek, f in self.frames(range(peak - step, -1, -step)):
            if self.over(event, f, track, recent, kalman, s.start_thr):
                event.start = seek + step
                break
            self.keep(event, f, True)
            event.start = seek
        return event


def detect(samples: np.ndarray, sample_rate: int, s: Settings) -> list[Event]:
    """Events before the spacing filter.

    A peak inside the last event is skipped; an event that starts inside the last one
    replaces it if longer, and else follows it.
    """
    step_ms = 1000 * s.FFT_size * (1 - s.FFT_overlap) / sample_rate
    events: list[Event] = []
    end = frames = 0
    grower = Grower(samples, sample_rate, s)
    for place, noise in find_peaks(samples, sample_rate, s):
        if place < end:
            continue
        event = grower.grow(place, noise)
        if not s.min_dur <= step_ms * event.frames <= s.max_dur:
            continue
        if event.start < end and event.frames > frames and events:
            events.pop()
        end, frames = event.end, event.frames
        events.append(event)
    return events


def extract(e: Event, sample_rate: int, s: Settings) -> dict:
    """The 27 features of an event, its tracks, and 1-based start and end."""
    step = hop(s.FFT_size, s.FFT_overlap)
    per_frame = 1000 * step / sample_rate
    freq = kalman_track(e.freq, s.KPE, s.KME) * (sample_rate / s.FFT_size)
    amp, harmonic = kalman_track(e.amp, s.KPE, s.KME), kalman_track(e.harmonic, s.KPE, s.KME)
    n = len(freq)
    spectrum = up_sample(e.spectrum, 512) if len(e.spectrum) < 512 else e.spectrum
    move = np.abs(np.diff(freq))
    knee = int(move.argmax()) + 1 if n > 1 and move.max() > 0 else 0
    calm = [(move[max(i - RECENT, 0) : i].mean(), i) for i in range(1, n) if i > n * 0.6]
    best = min(calm, default=(np.inf, 0))
    flat = best[1] if best[0] < s.FFT_size // 2 * 1000 else 0
    high, low, loud = int(freq.argmax()), int(freq.argmin()), int(amp.argmax())
    duration, width = n * per_frame, float(freq[high] - freq[low])
    fit = line_fit(freq)
    rest = freq - fit
    below = np.minimum(rest, 0)
    percent = lambda k: k / n * 100
    values = dict(
        starting_time=clock(e.start / sample_rate), duration=duration, freq_max_amp=freq[loud], freq_max=freq[high], freq_min=freq[low], bandwidth=width,
        freq_start=freq[0], freq_center=freq[n // 2], freq_end=freq[-1], freq_knee=freq[knee], fc=freq[flat], freq_bw_knee_fc=freq[knee] - freq[flat],
        bin_max_amp=quad_peak(spectrum, int(spectrum.argmax())) * sample_rate / 1024, pc_freq_max_amp=percent(loud), pc_freq_max=percent(high), pc_freq_min=percent(low), pc_knee=percent(knee),
        temp_bw_knee_fc=(knee - flat) * per_frame, slope=width / duration, kalman_slope=(value_at(fit, 0) - value_at(fit, 1)) / duration,
        curve_neg=np.maximum(rest, 0).sum(), curve_pos_start=below[: n // 2].sum(), curve_pos_end=below[n // 2 :].sum(), mid_offset=value_at(fit, 0.5) - value_at(freq, 0.5),
        snr=to_db(e.signal / max(e.noise, FLOOR)), hd=to_db(harmonic.sum() / max(amp.sum(), FLOOR)), smoothness=np.abs(np.diff(freq, 2)).sum() if n > 2 else 0.0,
    )
    values = {k: v if isinstance(v, str) else float(v) for k, v in values.items()}
    return values | {"event_start": e.start + 1, "event_end": e.end + 1, "amp_track": amp.tolist(), "freq_track": freq.tolist()}
