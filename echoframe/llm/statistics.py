"""Document statistics for classifiers, from whole texts."""

from __future__ import annotations

import numpy as np

from .text import NOT_SPACE, mix64, words

NAMES = (
    "log_words", "log_chars_per_word", "sd_word_length", "log_longest_word", "upper", "digits", "pipes", "bangs", "marks", "quotes", "sentence_ends",
    "commas", "spaces", "non_ascii", "distinct_words", "top_word", "repeat_next", "log_lines", "log_words_per_line", "repeated_lines", "marked_words", "upper_words", "entropy", "repeat_runs",
)
_CLASS = {
    "upper": range(65, 91), "digits": range(48, 58), "pipes": b"|", "bangs": b"!", "marks": b"#$%&*~^_=+<>\\{}[]@", "quotes": b"\"'()", "sentence_ends": b".?", "commas": b",;:",
    "spaces": b" \t\n\r\x0b\x0c", "non_ascii": range(128, 256),
}


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _squash(share: np.ndarray) -> np.ndarray:
    """A share on a scale on which small shares differ: log(x + 0.002)."""
    return np.log(np.maximum(share, 0) + 0.002)


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) transformed statistics per document; all are finite, also for empty texts."""
    docs = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out: dict[str, np.ndarray] = {}
    flags = np.zeros(256, dtype=np.int64)
    counts = np.zeros((docs, 256), dtype=np.int64)
    for d in range(docs):
        counts[d] = np.bincount(data[offsets[d] : offsets[d + 1]], minlength=256)
    for name, members in _CLASS.items():
        flags[:] = 0
        flags[list(members)] = 1
        out[name] = _squash(counts @ flags / size)
    p = counts / size[:, None]
    out["entropy"] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    w = words(data, offsets, NOT_SPACE)
    n = np.maximum(np.diff(w.first), 1)
    length = (w.end - w.start).astype(np.float64)
    mean = _sum_by(length, w.first) / n
    out["log_words"] = np.log1p(np.diff(w.first))
    out["log_chars_per_word"] = np.log1p(mean)
    out["sd_word_length"] = np.log1p(np.sqrt(np.maximum(_sum_by(length * length, w.first) / n - mean * mean, 0)))
    doc = np.repeat(np.arange(docs), np.diff(w.first))
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    out["log_longest_word"] = np.log1p(longest)
    out["distinct_words"], out["top_word"], out["repeated_lines"], out["log_lines"], out["log_words_per_line"], out["repeat_runs"] = (np.zeros(docs) for _ in range(6))
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    out["repeat_next"] = _squash(_sum_by(same, w.first) / n)
    newline = np.flatnonzero(data == 10)
    line_of = np.searchsorted(newline, w.start)
    last = data[np.maximum(w.end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    mark = np.zeros(256, dtype=bool)
    mark[list(b"#$%&*!|~^_=+<>\\{}[]@")] = True
    out["marked_words"] = _squash(_sum_by(mark[last], w.first) / n)
    upper = np.zeros(256, dtype=np.int8)
    upper[65:91] = 1
    lower = np.zeros(256, dtype=np.int8)
    lower[97:123] = 1
    ups, lows = np.zeros(len(data) + 1, dtype=np.int32), np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(upper[data], dtype=np.int32, out=ups[1:])
    np.cumsum(lower[data], dtype=np.int32, out=lows[1:])
    shout = (ups[w.end] - ups[w.start] > 1) & (lows[w.end] == lows[w.start])
    out["upper_words"] = _squash(_sum_by(shout, w.first) / n)
    chain = np.concatenate([[np.uint64(0)], np.cumsum(mix64(w.hash), dtype=np.uint64)]) if len(w.hash) else np.zeros(1, np.uint64)
    for d in range(docs):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        h = np.sort(w.hash[a:b])
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        runs = np.diff(np.append(cut, len(h)))
        out["distinct_words"][d] = len(cut) / len(h) ** 0.85
        out["top_word"][d] = runs.max() / len(h)
        lines = line_of[a:b]
        ends = np.append(np.flatnonzero(lines[1:] != lines[:-1]) + 1, b - a)
        starts = np.append(0, ends[:-1])
        keys = chain[a + ends] - chain[a + starts]
        distinct = len(np.unique(keys))
        out["repeated_lines"][d] = 1 - distinct / len(keys)
        out["log_lines"][d] = np.log1p(len(keys))
        out["log_words_per_line"][d] = np.log((b - a) / len(keys))
        if b - a > 8:
            four = chain[a + 4 : b + 1] - chain[a : b - 3]
            out["repeat_runs"][d] = 1 - len(np.unique(four)) / len(four)
    out["repeated_lines"] = _squash(out["repeated_lines"])
    out["repeat_runs"] = _squash(out["repeat_runs"])
    out["top_word"] = _squash(out["top_word"])
    return np.nan_to_num(np.stack([out[k] for k in NAMES], axis=1))
