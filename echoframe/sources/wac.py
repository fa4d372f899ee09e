"""WAC: Golomb-coded recordings, whole or in triggered segments.

Where the published decoder reads past its input or loses data, this one defines the
result: GPS and tag bits of a block are consumed, a segment still open at the end is
kept, both channels of a segment are kept, and a bad magic number, block header or
an early end are errors.
"""

from __future__ import annotations

import struct

import numpy as np

TRIGGERED, GPS, TAG = 0x10, 0x20, 0x40


class Bits:
    """Bits of 16-bit little-endian words, highest first."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at, self.left, self.word = raw, at, 0, 0

    def take(self, n: int) -> int:
        out = 0
        while n:
            if not self.left:
                if self.at + 2 > len(self.raw):
                    raise ValueError("unexpected end of a WAC file")
                self.word, self.left = self.raw[self.at] | self.raw[self.at + 1] << 8, 16
                self.at += 2
            k = min(n, self.left)
            out = out << k | (self.word >> (self.left - k)) & ((1 << k) - 1)
            self.left -= k
            n -= k
        return out

    def next_word(self) -> int:
        self.left = 0
        return self.take(16)


def read_wac(raw: bytes) -> dict:
    """sample_rate, channels and segments [(trigger sample, left, right or None)]."""
    if len(raw) < 26 or raw[:4] != b"WAac":
        raise ValueError("not a WAC file")
    version, channels, frame, block, flags = raw[4], raw[5], *struct.unpack_from("<HHH", raw, 6)
    rate, count, seek, entries = struct.unpack_from("<IIHH", raw, 12)
    if version > 4 or channels not in (1, 2) or channels * frame != 256:
        raise ValueError("unsupported WAC header")
    bits = Bits(raw, struct.unpack_from("<H", raw, 24)[0] * 2 if entries else 24)
    shift = flags & 0x0F
    segments, open_, start, done, number = [], [[] for _ in range(channels)], 0, 0, 0

    def close():
        if open_[0]:
            segments.append((start, np.array(open_[0], dtype=np.int32), np.array(open_[1], dtype=np.int32) if channels > 1 else None))
            for c in open_:
                c.clear()

    while done < count:
        if number % block == 0:
            index = number // block
            if [bits.next_word() for _ in range(4)] != [0x8000, 1, index & 0xFFFF, index >> 16 & 0xFFFF]:
                raise ValueError("bad WAC block header")
            if flags & GPS and seek and index % seek == 0:
                bits.take(25), bits.take(26)
            if flags & TAG:
                bits.take(4)
        number += 1
        widths = [bits.take(4) for _ in range(channels)]
        if not all(widths):
            close()
        else:
            if not open_[0]:
                start = done
            last = [0] * channels
            for _ in range(frame):
                for c, g in enumerate(widths):
                    code = bits.take(g)
                    stop = (code & 1) ^ 1
                    while bits.take(1) != stop:
                        code += 1 << g
                        stop ^= 1
                    last[c] += -(code + 1) // 2 if code & 1 else code // 2
                    value = last[c] << shift & 0xFFFF
                    open_[c].append(value - 0x10000 if value > 0x7FFF else value)
        done += frame
    close()
    if not flags & TRIGGERED and len(segments) > 1:  # zero frames are silence only in triggered files
        raise ValueError("a zero frame in a WAC file without triggers")
    return dict(sample_rate=rate, bit_depth=16, channels=channels, segments=segments, triggered=bool(flags & TRIGGERED))
