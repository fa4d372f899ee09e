"""MP3: frame headers, and decoding by a function that the user brings."""

from __future__ import annotations

# kbit/s of layer III by version (MPEG 1; MPEG 2 and 2.5), and rates by version.
KBITS = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mp3_header(raw: bytes) -> dict:
    """sample_rate, channels and kbits of the first frame, behind an ID3 tag if there is one."""
    at = 0
    if raw[:3] == b"ID3" and len(raw) > 10:
        at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(raw[6:10]))
    while at + 4 <= len(raw):
        a, b, c, d = raw[at : at + 4]
        version, layer, kbits, rate = b >> 3 & 3, b >> 1 & 3, c >> 4, c >> 2 & 3
        if a == 0xFF and b >= 0xE0 and version != 1 and layer == 1 and 0 < kbits < 15 and rate < 3:
            return dict(sample_rate=RATES[version][rate], channels=1 if d >> 6 == 3 else 2, kbits=KBITS[3 if version == 3 else 2][kbits])
        at += 1
    raise ValueError("no MP3 frame found")
