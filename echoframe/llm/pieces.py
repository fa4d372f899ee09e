"""Byte-level pre-tokens in whole buffers, and token ids through a cache of distinct pre-tokens.

The pre-token pattern of byte-level BPE (PATTERN of the tokenizer files) splits a
text into pieces that are encoded one by one.  Texts of ASCII and Latin-1 letters
are split here with array operations; any other text is left to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .text import U64, _BYTE, _power_tables, mix64

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[[*range(48, 58)]] = NUMBER
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
#: U+00C0 to U+00FF, but for the two signs among them, are letters: lead byte 0xC3.
_KIND[[0xC3, *range(0x80, 0xC0)]] = LETTER
_FOREIGN = np.zeros(256, dtype=bool)
_FOREIGN[[*range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_CHUNK = 1 << 18


def _spelling() -> dict[int, str]:
    """How byte-level BPE spells bytes: printable Latin-1 as itself, the others from U+0100 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_SPELLING = _spelling()


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the array rules cover: ASCII and Latin-1 letters only."""
    odd = _FOREIGN[data]
    if len(data) > 1:
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[offsets[1:]] == total[offsets[:-1]]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of plain texts start (every byte belongs to a piece)."""
    n = len(data)
    kind = _KIND[data]
    start = np.zeros(n + 1, dtype=bool)
    if n:
        start[1:n] = kind[1:] != kind[:-1]
        # the last of some white space before something else: a piece, or a blank that joins what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        last = last[~cut[last + 1]]
        start[last] = True
        start[last + 1] = data[last] != 0x20
        # 's and so on: a lone apostrophe that starts a piece takes an ending
        lone = np.flatnonzero((data == 0x27) & (kind == OTHER))
        for p in lone[(start[lone] | cut[lone])]:
            if p + 1 < n and not cut[p + 1] and kind[p + 1] == LETTER:
                stop = offsets[np.searchsorted(offsets, p, side="right")]
                following = data[p + 1 : min(p + 3, stop)].tobytes()
                ending = next((e for e in _ENDINGS if following.startswith(e)), None)
                if ending:
                    start[p + 1] = False
                    after = p + 1 + len(ending)
                    if after < stop and kind[after] == LETTER:
                        start[after] = True
        start |= cut
    return np.flatnonzero(start[:n])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which are in order."""
    out = np.zeros(len(starts), dtype=U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _CHUNK, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _power_tables(hi - lo)
        total = np.concatenate([[U64(0)], np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], dtype=U64)])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix64((total[e] - total[s]) * down[np.minimum(s, len(down) - 1)] + (e - s).astype(U64))
        a = b
    return out


class Ragged:
    """Rows of different length in one array."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.flat, self.at = flat, at

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The given rows, one after the other."""
        length = self.at[rows + 1] - self.at[rows]
        total = int(length.sum())
        where = np.arange(total) + np.repeat(self.at[rows] - (np.cumsum(length) - length), length)
        return self.flat[where]

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.at[rows + 1] - self.at[rows]


class Cache:
    """Values of distinct spans by hash; forgets all when it holds `most`."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, dtype=U64)
        self.rows = Ragged(np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the (sorted, distinct) keys aren't known."""
        if not len(self.keys):
            return np.ones(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, values: Ragged) -> None:
        """Sorted keys that are all new."""
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        at = np.concatenate([self.rows.at, values.at[1:] + self.rows.at[-1]])
        both = Ragged(np.concatenate([self.rows.flat, values.flat]), at)
        flat = both.take(order)
        self.rows = Ragged(flat, np.concatenate([[0], np.cumsum(both.lengths(order))]))
        self.keys = np.concatenate([self.keys, keys])[order]


class Encoder:
    """Ids of texts as the tokenizers library gives them, with each distinct piece encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without the pattern, for pieces in byte-level spelling that line breaks set apart
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Split(_SPELLING[10], "isolated")
        self.newline = self.tokenizer.token_to_id(_SPELLING[10])
        self.cache = Cache()

    def _new(self, pieces: list[bytes]) -> Ragged:
        """Ids of single pieces. Those without a line break are encoded as one text, cut at line breaks."""
        joined = [k for k, p in enumerate(pieces) if b"\n" not in p] if self.newline is not None else []
        alone = sorted({*range(len(pieces))} - {*joined})
        flats, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(joined), 4000):
            text = b"\n".join([pieces[k] for k in joined[a : a + 4000]]).decode("latin-1").translate(_SPELLING)
            flat = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)
            cuts = np.flatnonzero(flat == self.newline)
            flats.append(np.delete(flat, cuts))
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(flat)]])) - 1)
        for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in alone], add_special_tokens=False):
            flats.append(np.array(e.ids, dtype=np.int32))
            lengths.append(np.array([len(flats[-1])]))
        both = Ragged(np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64))
        order = np.argsort(np.array(joined + alone, dtype=np.int64))
        return Ragged(both.take(order), np.concatenate([[0], np.cumsum(both.lengths(order))]).astype(np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Ragged:
        """Ids of each text of a buffer."""
        docs = len(offsets) - 1
        plain = plain_texts(data, offsets)
        if b"<|" in data.tobytes():  # a special string may be inside
            for d in np.flatnonzero(plain):
                if b"<|" in data[offsets[d] : offsets[d + 1]].tobytes():
                    plain[d] = False
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        use = plain[doc] if len(doc) else np.zeros(0, bool)
        starts, ends, doc = starts[use], ends[use], doc[use]
        keys, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.cache.missing(keys))
        if len(self.cache.keys) + len(new) > self.cache.most:
            self.cache.clear()
            new = np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self.cache.add(keys[new], self._new([raw[starts[k] : ends[k]] for k in first[new]]))
        row = np.searchsorted(self.cache.keys, keys)[inverse]
        length = np.bincount(doc, weights=self.cache.rows.lengths(row), minlength=docs).astype(np.int64)
        flat = self.cache.rows.take(row)
        if plain.all():
            return Ragged(flat, np.concatenate([[0], np.cumsum(length)]))
        at = np.concatenate([[0], np.cumsum(length)])
        others = np.flatnonzero(~plain)
        whole = dict(zip(others.tolist(), (np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast([data[offsets[d] : offsets[d + 1]].tobytes().decode() for d in others], add_special_tokens=False))))
        parts = [whole[d] if d in whole else flat[at[d] : at[d + 1]] for d in range(docs)]
        return Ragged(np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))


def text_buffers(texts: list[str]):
    from .text import buffers

    return buffers(pa.array(texts, pa.large_string()))
