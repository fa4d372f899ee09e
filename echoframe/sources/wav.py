"""WAV (PCM) bytes to samples and back."""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

PCM, EXTENSIBLE = 1, 0xFFFE
# Fixed value: the sub-format GUID of PCM in an extensible header.
PCM_GUID = bytes.fromhex("0100000000001000800000aa00389b71")


@dataclass(frozen=True)
class Layout:
    """Where the samples of a WAV file lie: `frames` of them in each channel, from byte `at` on."""

    rate: int
    bits: int
    channels: int
    at: int
    frames: int

    @property
    def width(self) -> int:
        """Bytes of a sample of all channels."""
        return self.bits // 8 * self.channels

    def span(self, start: float | None, stop: float | None, time_exp: float = 1) -> tuple[int, int]:
        """First and last (exclusive) sample of a range in seconds of expanded time."""
        a = 0 if start is None else min(int(start * time_exp * self.rate), self.frames)
        b = self.frames if stop is None else min(int(stop * time_exp * self.rate), self.frames)
        return a, max(a, b)


def layout(f: BinaryIO) -> Layout:
    """The layout of an open file; reads the heads of its chunks only."""
    total = f.seek(0, io.SEEK_END)
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= total and (form is None or data is None):
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", f.read(16))
        elif name == b"data":
            data = (at + 8, size)
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("a WAV file needs a fmt and a data chunk")
    kind, channels, rate, _, _, bits = form
    if kind not in (PCM, EXTENSIBLE):
        raise ValueError(f"WAV format {kind} is not PCM")
    if bits not in (8, 16, 24, 32):
        raise ValueError(f"{bits} bits a sample are not supported")
    return Layout(rate, bits, channels, data[0], min(data[1], total - data[0]) // (bits // 8 * channels))


def samples(f: BinaryIO, where: Layout, a: int, b: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Samples a to b (exclusive) of both channels; no other bytes of the file are read."""
    f.seek(where.at + a * where.width)
    data = np.frombuffer(f.read((b - a) * where.width), dtype=np.uint8)
    width = where.bits // 8
    if width == 1:
        values = data.astype(np.int32) - 128
    elif width == 3:
        wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = data.reshape(-1, 3)
        values = wide.reshape(-1).view("<i4") >> 8
    else:
        values = data.view(f"<i{width}").astype(np.int32)
    values = values.reshape(-1, where.channels)
    return values[:, 0], values[:, 1] if where.channels > 1 else None


def read_wav(raw: bytes, start: float | None = None, stop: float | None = None, time_exp: float = 1) -> dict:
    """Samples of one or two channels; start and stop in seconds of expanded time."""
    f = io.BytesIO(raw)
    where = layout(f)
    left, right = samples(f, where, *where.span(start, stop, time_exp))
    return dict(sample_rate=int(where.rate * time_exp), bit_depth=where.bits, channels=where.channels, left=left, right=right)


def write_wav(left, sample_rate: int, right=None, bit_depth: int = 16, extra: list[tuple[bytes, bytes]] = ()) -> bytes:
    """A WAV file; rates above 44,100 Hz get an extensible header. extra: further chunks."""
    columns = [np.asarray(left)] + ([np.asarray(right)] if right is not None else [])
    values = np.stack(columns, axis=1)
    if bit_depth not in (8, 16, 24, 32):
        raise ValueError(f"{bit_depth} bits a sample are not supported")
    width, channels = bit_depth // 8, len(columns)
    if width == 1:
        body = (values + 128).astype(np.uint8).tobytes()
    elif width == 3:
        body = values.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = values.astype(f"<i{width}").tobytes()
    wide = sample_rate > 44100
    head = struct.pack("<HHIIHH", EXTENSIBLE if wide else PCM, channels, sample_rate, sample_rate * channels * width, channels * width, bit_depth)
    if wide:
        head += struct.pack("<HHI", 22, bit_depth, (1 << channels) - 1) + PCM_GUID
    parts = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in [(b"fmt ", head), *extra, (b"data", body)])
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts
