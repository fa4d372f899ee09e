"""Token counts by rank-synchronous array merging.

Texts are cut into chunks that no vocabulary piece crosses (white space with what
follows it; characters that occur in no piece stand alone).  The distinct chunks
of a batch are ragged arrays of symbols, held in matrices of like length.  Each
round applies to every sequence at once its lowest-ranked adjacent pair (leftmost
of equal ones), until no sequence has a pair; the surviving symbols are counted,
characters outside the vocabulary as their UTF-8 bytes.  Sequences of more than
LONG symbols, where rounds would be many, go through the same rule with a heap.

Defined results: a null text is an empty one and has no tokens; an empty table gives an
empty result; very long texts are counted whole; repeated rows give repeated results;
doc_id may be of any type, and further columns are not read.  Models that cut or
normalise texts in another way than byte-fallback BPE with a mark in front are refused.
"""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Cache, Ragged, hash_spans
from .shared import pieces
from .text import buffers

LONG = 128
_NONE = np.int32(2**31 - 1)
_MARK = "▁"  # stands for a blank


class MergeTable:
    """Symbols and ranked pairs of a sentencepiece BPE model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in usual}
        self.number = {p: i for i, p in text.items()}
        if any(_MARK in p.lstrip(_MARK) for p in self.number):
            raise ValueError("a piece crosses a blank; chunks can't be cut there")
        # symbols that arise: pieces, and single characters of pieces that are no pieces themselves
        spare = model.get_piece_size()
        for p in list(self.number):
            for c in p:
                if c not in self.number:
                    self.number[c] = spare
                    spare += 1
        self.size = spare
        #: a symbol that is no piece counts as its bytes
        self.weight = np.ones(spare, dtype=np.int64)
        for c, i in self.number.items():
            if i >= model.get_piece_size():
                self.weight[i] = len(c.encode())
        order = sorted(usual, key=lambda i: (-model.get_score(i), i))
        scores = [model.get_score(i) for i in order]
        rank, self.rank = -1, {}
        for k, i in enumerate(order):
            rank += k == 0 or scores[k] != scores[k - 1]
            self.rank[i] = rank
        pairs = {}
        for i, p in text.items():
            for k in range(1, len(p)):
                a, b = self.number.get(p[:k]), self.number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (self.rank[i], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in sorted(pairs)], dtype=np.int32)
        characters = sorted((ord(p), i) for p, i in self.number.items() if len(p) == 1)
        self.points = np.array([c for c, _ in characters], dtype=np.uint32)
        self.symbols = np.array([i for _, i in characters], dtype=np.int32)
        known = {c for c, _ in characters}
        #: ASCII bytes in no piece
        self.lone = np.zeros(256, dtype=bool)
        self.lone[[b for b in range(128) if b != 0x20 and b not in known]] = True

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no pair) and merged symbol of adjacent symbols; negative symbols never pair."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def symbolise(self, chunks: list[bytes]) -> Ragged:
        """Symbols of each chunk; an unknown character is minus its UTF-8 length."""
        texts = [c.decode().replace(" ", _MARK) for c in chunks]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        size = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        return Ragged(np.where(self.points[at] == points, self.symbols[at], -size).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))

    def weigh(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols >= 0, self.weight[np.maximum(symbols, 0)], -symbols)

    def count(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of each chunk."""
        rows = self.symbolise(chunks)
        length = np.diff(rows.at)
        out = np.zeros(len(chunks), dtype=np.int64)
        low = 0
        for high in (4, 6, 8, 12, 16, 24, 32, 64, LONG):
            group = np.flatnonzero((length > low) & (length <= high))
            for k in range(0, len(group), 1 << 15):
                part = group[k : k + (1 << 15)]
                grid = np.zeros((len(part), high), dtype=np.int32)
                filled = np.arange(high)[None, :] < length[part][:, None]
                grid[filled] = rows.take(part)
                out[part] = self._rounds(grid, length[part])
            low = high
        for k in np.flatnonzero(length > LONG):
            out[k] = self._heap(rows.flat[rows.at[k] : rows.at[k + 1]].tolist())
        return out

    def _rounds(self, s: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Merge rows of symbols until none has a pair; the weights of what is left."""
        out = np.zeros(len(s), dtype=np.int64)
        row_of = np.arange(len(s))
        width = s.shape[1]
        column = np.arange(width)
        rank, _ = self.look_up(s[:, :-1], s[:, 1:])
        rank = np.where(column[None, :-1] < length[:, None] - 1, rank, _NONE)
        while True:
            if width > 1:
                spot = rank.argmin(axis=1)
                ready = rank[np.arange(len(s)), spot] < _NONE
            else:
                ready = np.zeros(len(s), dtype=bool)
            if not ready.all():
                still = ~ready
                weights = np.where(column[None, :] < length[still][:, None], self.weigh(s[still]), 0)
                out[row_of[still]] = weights.sum(axis=1)
                s, rank, length, row_of = s[ready], rank[ready], length[ready], row_of[ready]
                if not len(s):
                    return out
                spot = spot[ready]
            each = np.arange(len(s))
            _, merged = self.look_up(s[each, spot], s[each, spot + 1])
            later = column[None, :] > spot[:, None]
            s = np.take_along_axis(s, np.minimum(column[None, :] + later, width - 1), axis=1)
            s[each, spot] = merged
            length = length - 1
            later = column[None, : width - 1] > spot[:, None]
            rank = np.take_along_axis(rank, np.minimum(column[None, : width - 1] + later, width - 2), axis=1)
            rank[each, np.minimum(length - 1, width - 2)] = np.where(length - 1 <= width - 2, _NONE, rank[each, np.minimum(length - 1, width - 2)])
            for shift in (-1, 0):  # the pairs beside the new symbol
                at = spot + shift
                ok = np.flatnonzero((at >= 0) & (at + 1 < length))
                r, _ = self.look_up(s[ok, at[ok]], s[ok, at[ok] + 1])
                rank[ok, at[ok]] = r

    def _heap(self, s: list[int]) -> int:
        """The same rule for one long sequence."""
        follow, before = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
        ranks, merged = (x.tolist() for x in self.look_up(np.array(s[:-1]), np.array(s[1:])))
        heap = [(r, k, s[k], s[k + 1], m) for k, (r, m) in enumerate(zip(ranks, merged)) if r < _NONE]
        heapq.heapify(heap)
        alive = [True] * len(s)
        index = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist()))) if not hasattr(self, "_index") else self._index
        self._index = index
        while heap:
            _, k, a, b, m = heapq.heappop(heap)
            n = follow[k]
            if not alive[k] or n < 0 or s[k] != a or s[n] != b:
                continue
            s[k] = m
            alive[n] = False
            follow[k] = follow[n]
            if follow[k] >= 0:
                before[follow[k]] = k
            for x, y in ((before[k], k), (k, follow[k])):
                if x >= 0 and y >= 0 and s[x] >= 0 and s[y] >= 0 and (found := index.get(s[x] * self.size + s[y])):
                    heapq.heappush(heap, (found[0], x, s[x], s[y], found[1]))
        left = np.array([x for x, on in zip(s, alive) if on])
        return int(self.weigh(left).sum())


#: Texts that other normalisers, prefixes, piece types or byte rules would count in another way.
_PROBES = ("", " ", "a", "  two  blanks ", "a\tb\n\nc", "ＡＢ ﬁ ① ½", "e\u0301 é", "日本語 😀 \u0000", "don't 12345 x1y2", "<s> </s> <unk>", "▁a", "AbC zzzzzzzzqqqq")


class Counter:
    """Token counts of texts, with each distinct chunk merged once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.table = MergeTable(path)
        self.cache = Cache()
        model = SentencePieceProcessor(model_file=path)
        if self.count(*buffers(pa.array(_PROBES, pa.large_string()))).tolist() != [len(model.encode(t)) for t in _PROBES]:
            raise ValueError(f"{path}: its normaliser or pieces are not those that these rules count")

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        if _MARK.encode() in (raw := data.tobytes()):  # a mark in the text is as good as a blank
            data, offsets = buffers(pa.array([raw[a:b].decode().replace(_MARK, " ") for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string()))
        filled = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][filled], 0x20)  # each text starts with a mark
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        n = len(data)
        if not n:
            return np.zeros(docs, dtype=np.int64)
        blank, lone = data == 0x20, self.table.lone[data]
        start = np.zeros(n + 1, dtype=bool)
        start[1:n] = (blank[1:] & ~blank[:-1]) | lone[1:] | lone[:-1]
        start[offsets] = True
        starts = np.flatnonzero(start[:n])
        ends = np.append(starts[1:], n)
        keys, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.cache.missing(keys))
        if len(self.cache.keys) + len(new) > self.cache.most:
            self.cache.clear()
            new = np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            counts = self.table.count([raw[starts[k] : ends[k]] for k in first[new]])
            self.cache.add(keys[new], Ragged(counts.astype(np.int32), np.arange(len(new) + 1, dtype=np.int64)))
        tokens = self.cache.rows.flat[np.searchsorted(self.cache.keys, keys)][inverse]
        total = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
        at = np.searchsorted(starts, offsets)
        return total[at[1:]] - total[at[:-1]]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs; model is a file of public_tokenizers or a path."""

    def run(batches):
        import public_tokenizers

        path = model if os.path.sep in model else public_tokenizers.path(model)
        if path not in _counters:
            _counters[path] = Counter(path)
        for batch in pieces(batches):
            data, offsets = buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(_counters[path].count(data, offsets))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
