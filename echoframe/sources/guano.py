"""GUANO metadata of WAV files."""

from __future__ import annotations

import io
import struct
from typing import BinaryIO

# Keys with numbers.
DOUBLES = ("Filter HP", "Filter LP", "Humidity", "Length", "Loc Elevation", "Temperature Ext", "Temperature Int")
INTS = ("Loc Accuracy", "Samplerate", "TE")


def guano_text(raw: bytes | BinaryIO) -> str | None:
    """The text of the guan chunk of a file or its bytes; both readings of odd chunk sizes are tried, and other chunks are passed over unread."""
    f = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    total = f.seek(0, io.SEEK_END)
    for pad in (1, 0):
        at = 12
        while at + 8 <= total:
            f.seek(at)
            name, size = struct.unpack("<4sI", f.read(8))
            if name == b"guan":
                return f.read(size).decode("utf-8", "replace").rstrip("\0")
            at += 8 + size + (size & pad)
    return None


def parse_guano(text: str | None) -> dict[str, str]:
    """Keys and values, split at the first colon of each line; position splits in two, notes get their line breaks."""
    out = {}
    for line in (text or "").split("\n"):
        key, found, value = line.strip().partition(":")
        if found and key.strip():
            out[key.strip()] = value.strip()
    if "Note" in out:
        out["Note"] = out["Note"].replace("\\n", "\n")
    if out.get("TE") == "":
        out["TE"] = "1"
    if "Loc Position" in out:
        place = out.pop("Loc Position").split()
        out |= dict(zip(("Loc Position Lat", "Loc Position Lon"), place))
    return out


def guano_chunk(values: dict[str, str]) -> tuple[bytes, bytes]:
    """A chunk for write_wav."""
    return b"guan", "\n".join(f"{k}: {v}".replace("\n", "\\n") if k == "Note" else f"{k}: {v}" for k, v in values.items()).encode()
