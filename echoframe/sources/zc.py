"""Zero-crossing files (types 129 to 132): header, dots, and rewriting of header texts."""

from __future__ import annotations

import struct

# Text fields from byte 6 on, and their lengths.
FIELDS = (("TAPE", 8), ("DATE", 8), ("LOC", 40), ("SPECIES", 50), ("SPEC", 16), ("NOTE", 74), ("NOTE1", 79))
TEXT_AT, TABLE_AT, LONGEST = 6, 0x11A, 16384


def _text(raw: bytes) -> str:
    return raw.replace(b"\0", b" ").decode("latin-1").strip()


def read_zc(raw: bytes) -> dict:
    """Metadata, and dots as lists: time (µs), frequency (Hz or None), status (or None)."""
    raw = raw[:LONGEST]
    if len(raw) < TABLE_AT + 6:
        raise ValueError("file is corrupted")
    kind = raw[3]
    if not 129 <= kind <= 132:
        raise ValueError("file type must be between 129 and 132")
    if struct.unpack_from("<H", raw, 0)[0] != TABLE_AT:
        raise ValueError("file is corrupted")
    data_at, res1, ratio, vres = struct.unpack_from("<HHBB", raw, TABLE_AT)
    if not 10000 <= res1 <= 60000 or not 1 <= ratio <= 64:
        raise ValueError("file is corrupted")
    md, at = {"FTYPE": kind}, TEXT_AT
    for name, size in FIELDS:
        md[name] = _text(raw[at : at + size])
        at += size
    md |= {"RES1": res1, "DIVRAT": ratio, "VRES": vres, "time_factor": res1 / 25000}
    guano = {}
    if kind == 132:
        year, month, day, hour, minute, second, hundredths, micros = struct.unpack_from("<HBBBBBBH", raw, TABLE_AT + 6)
        md["DATE"] = f"{year}{month:02d}{day:02d}_{hour:02d}:{minute:02d}:{second:02d}.{hundredths * 100 + micros:06d}"
        md["GPS"] = _gps(raw[TABLE_AT + 22 : TABLE_AT + 50])
        altitude = _text(raw[TABLE_AT + 50 : TABLE_AT + 54])
        md["ALTITUDE"] = int(altitude) if altitude.lstrip("+-").isdigit() else None
        if data_at != 0x150:
            guano = _guano(raw[0x150:data_at].decode("utf-8", "replace"))
    elif kind in (130, 131):
        md["DATE"] = None  # in the file name
    if kind < 132 and data_at != 0x120:
        raise ValueError("file is corrupted")
    time, status = _dots(raw, data_at, kind, res1, md["time_factor"])
    low, high = max(48, 4 * ratio), min(12859, 250 * ratio)
    freq: list[int | None] = [None] * len(time)
    for k in range(2, len(time)):
        gap = time[k] - time[k - 2]
        if low <= gap <= high:
            freq[k] = ratio * 1_000_000 // gap
    head = [0, 0] if kind == 129 else [0, 1]
    status[: len(head)] = head[: len(status)]
    md["n_data_points"] = len(time)
    return dict(metadata=md, guano=guano, time_us=time, freq_hz=freq, status=status)


def _gps(part: bytes) -> str:
    datum, rest = _text(part[:10]), part[10:].decode("latin-1")
    if rest[0] in "NS":
        return f"{datum} {int(rest[1:3])}.{rest[3:8]} {rest[0]}, {int(rest[10:13])}.{rest[13:18]} {rest[9]}"
    return f"{datum} {rest[:3]} {rest[4:10]}, {rest[11:18]}"


def _guano(text: str) -> dict[str, str]:
    out = {}
    for part in text.split("|"):
        for line in part.split("\n"):
            key, found, value = line.partition(":")
            if found and key.strip():
                out[key.strip()] = value.strip()
    return out


def _dots(raw: bytes, p: int, kind: int, res1: int, factor: float) -> tuple[list[int], list[int | None]]:
    """Times of the dots (the first is 0) and their status."""
    time, status, interval = [0], {}, 0

    def add(value: int) -> None:
        nonlocal interval
        interval = value
        time.append(time[-1] + (value if res1 == 25000 else int((factor * value + 0.5) // 1)))

    def mark(first: int, count: int, value: int) -> None:
        for k in range(first, first + count):
            status[k] = value

    while p < len(raw) and len(time) < LONGEST:
        b = raw[p]
        n = len(time)  # 0-based number of the next dot
        if b < 0x80:
            add(interval + (b - 128 if b > 63 else b))
            p += 1
        elif kind == 129:
            if b > 0xF8:
                mark(n + 1, b - 0xF8, 1)
                p += 1
            elif p + 1 < len(raw):
                add(((b & 7) << 8 | raw[p + 1]) << (b >> 3 & 15))
                p += 2
            else:
                break
        elif b >= 0xE0:
            if kind == 130:
                mark(n, b - 0xE0, 1)
                p += 1
            elif p + 2 < len(raw):
                mark(n + 1, min(raw[p + 1], LONGEST - 1 - n), b & 3)
                p += 2
            else:
                break
        else:
            size = 1 + (b >> 5 & 3)
            if size == 1 and n < LONGEST:
                status[n] = 2
            if p + size >= len(raw):
                break
            add(int.from_bytes(bytes([b & 0x1F]) + raw[p + 1 : p + 1 + size], "big"))
            p += size + 1
    return time, [status.get(k) for k in range(len(time))]


def write_zc(raw: bytes, metadata: dict) -> bytes:
    """The file with its header texts replaced, padded and cut; the dots stay as they are. Type 132 has no DATE text."""
    out, at = bytearray(raw), TEXT_AT
    for name, size in FIELDS:
        text = "" if name == "DATE" and metadata.get("FTYPE", raw[3]) == 132 else metadata.get(name) or ""
        out[at : at + size] = text.encode("latin-1", "replace")[:size].ljust(size)
        at += size
    return bytes(out)
