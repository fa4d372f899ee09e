"""Benchmark decontamination by suffix arrays of the training texts.

Each Arrow batch of documents is a shard: its words are numbered by the benchmark's
vocabulary, the suffixes that start with words found at the start of some benchmark
window are sorted by their leading words (a sparse suffix array: other suffixes cannot
match a window), and every benchmark suffix of a window's length at least is looked up by
binary search.  Each match is a place in a document and one in an item; matches that go
on side by side are one longer match, so its length is that of the longest verbatim
match along the item's suffix, however long.  Common runs shorter than a window aren't
sought.  No shuffle is needed; the benchmark is sent out in blocks of bounded size, which
one worker a task goes through, holding at most KEEP of them.

Defined results: null or wordless texts are clean; null item ids count as the
empty string; items without words have no window; repeated items count once by
id; an empty benchmark leaves all documents clean; an empty table gives an empty result;
repeated documents are each looked at; further columns aren't read (remove_contaminated
returns them as they are).  A text is never split, so a very long one makes a large shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces
from .text import ALNUM, U64, buffers, hash_words, words

#: Bytes of benchmark text in one block (the bound of what is sent to tasks).
BLOCK_BYTES = 8 << 20
#: Blocks that a worker keeps at once; beyond them each is loaded again when its turn comes.
KEEP = 16
#: Pairs of a document's place (or window) and an item's that are held at once.
PAIRS = 1 << 20


class Windows:
    """The windows of one benchmark block, ready for lookup."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        hashed = hash_words([t for _, t in items], ALNUM)
        self.size = size
        self.ids, self.names = sorted({i for i, _ in items}), [i for i, _ in items]
        at = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, U64), *hashed]))
        keys, lengths, owners, starts, begin = [np.zeros(0, f"S{3 * size}")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        self.begin = []
        for row, ((item, _), h) in enumerate(zip(items, hashed)):
            number = np.searchsorted(self.vocabulary, h) + 1
            length = min(size, len(h))
            if length:
                place = np.arange(len(h) - length + 1)
                keys.append(packed(number[place[:, None] + np.arange(length)], size))
                lengths.append(np.full(len(place), length))
                owners.append(np.full(len(place), at[item]))
                starts.append(begin + place)
            self.begin.append(begin)
            begin += len(h) + 1
        keys, lengths, owners, starts = (np.concatenate(x) for x in (keys, lengths, owners, starts))
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys, return_index=True)
        self.lengths = lengths[first]
        #: places (in all items, one after the other) and items of each window
        self.start_at = np.append(np.searchsorted(keys[order], self.keys), len(keys))
        self.start = starts[order]
        both = np.unique(np.searchsorted(self.keys, keys) * max(len(self.ids), 1) + owners)
        self.owner_at, self.owner = np.searchsorted(both // max(len(self.ids), 1), np.arange(len(self.keys) + 1)), both % max(len(self.ids), 1)
        self.begin = np.array(self.begin, dtype=np.int64)
        #: every window starts with one of these runs of `lead` words
        self.lead = int(min(3, self.lengths.min())) if len(self.lengths) else 0
        self.lead_numbers = np.unique(_lead_number(np.array([[int.from_bytes(k.ljust(3 * size, b"\0")[3 * j : 3 * j + 3], "big") for j in range(self.lead)] for k in map(bytes, self.keys)], dtype=np.int64).reshape(len(self.keys), self.lead)))


def packed(numbers: np.ndarray, width: int) -> np.ndarray:
    """Rows of word numbers (below 2**24, 1 at least) as byte strings that sort as the rows do."""
    rows = np.zeros((numbers.shape[0], 3 * width), dtype=np.uint8)
    for j in range(numbers.shape[1]):
        rows[:, 3 * j], rows[:, 3 * j + 1], rows[:, 3 * j + 2] = numbers[:, j] >> 16, (numbers[:, j] >> 8) & 255, numbers[:, j] & 255
    return rows.view(f"S{3 * width}")[:, 0]


def _lead_number(numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(numbers), dtype=np.int64)
    for j in range(numbers.shape[1]):
        out = (out << 21) ^ numbers[:, j] * (0x9E3779B1 if j % 2 else 1)
    return out


def _each(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each of the rows has, and all of them one after the other."""
    n = bounds[rows + 1] - bounds[rows]
    return n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[rows], n)


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Stretches whose sizes add up to PAIRS at most (or that are one element)."""
    done, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(done, done[a] - sizes[a] + PAIRS, side="right")))
        yield slice(a, b)
        a = b


class Shard:
    """The words of a batch, and what of the benchmark's blocks is found in them."""

    def __init__(self, column: pa.Array, size: int):
        self.words = w = words(*buffers(column), ALNUM)
        self.docs = len(w.first) - 1
        self.n_words = np.diff(w.first)
        # one stop (0) after each document
        self.doc_of = np.repeat(np.arange(self.docs), self.n_words)
        self.place = np.arange(len(w.hash)) + self.doc_of
        self.first = w.first[:-1] + np.arange(self.docs)
        self.length = len(w.hash) + self.docs + size
        self.hit = np.zeros(self.length, dtype=bool)
        self.items: dict[int, set[str]] = {}
        #: by document: length, first word, item and its first word of the longest match
        self.longest: dict[int, tuple[int, int, str, int]] = {}

    def look_up(self, block: Windows) -> None:
        w, number = self.words, np.zeros(self.length, dtype=np.int64)
        if not len(block.keys) or not len(w.hash):
            return
        at = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
        number[self.place] = np.where(block.vocabulary[at] == w.hash, at + 1, 0)
        candidate = np.flatnonzero(number)
        for j in range(1, block.lead):
            candidate = candidate[number[candidate + j] > 0]
        lead = _lead_number(number[candidate[:, None] + np.arange(block.lead)])
        candidate = candidate[np.isin(lead, block.lead_numbers)]
        if len(candidate):
            self._search(candidate, number, block)

    def _search(self, candidate: np.ndarray, number: np.ndarray, block: Windows) -> None:
        live = np.ones(len(candidate), dtype=bool)
        rows = np.zeros((len(candidate), block.size), dtype=np.int64)
        for j in range(block.size):
            rows[:, j] = np.where(live, number[candidate + j], 0)
            live &= rows[:, j] > 0
        suffix = packed(rows, block.size)
        order = np.argsort(suffix, kind="stable")
        suffix, candidate = suffix[order], candidate[order]
        low = np.searchsorted(suffix, block.keys, side="left")
        upper = np.array([bytes(k).ljust(3 * int(n), b"\0")[: 3 * int(n)].ljust(3 * block.size, b"\xff") for k, n in zip(block.keys, block.lengths)], dtype=f"S{3 * block.size}")
        count = np.searchsorted(suffix, upper, side="right") - low
        window = np.repeat(np.arange(len(block.keys)), count)
        at = candidate[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        if not len(at):
            return
        edge = np.zeros(self.length + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.lengths[window], -1)
        self.hit |= np.cumsum(edge[:-1]) > 0
        owner_of = np.full(self.length, -1)
        owner_of[self.place] = self.doc_of
        pairs = np.unique(owner_of[at].astype(np.int64) * len(block.keys) + window)
        doc, held = pairs // len(block.keys), pairs % len(block.keys)
        for part in _parts(np.diff(block.owner_at)[held]):
            n, x = _each(block.owner_at, held[part])
            found = np.unique(np.repeat(doc[part], n) * len(block.ids) + block.owner[x])
            for d, k in zip((found // len(block.ids)).tolist(), (found % len(block.ids)).tolist()):
                self.items.setdefault(d, set()).add(block.ids[k])
        order = np.argsort(at, kind="stable")
        at, window = at[order], window[order]
        live = (np.zeros(0, np.int64),) * 4
        for part in _parts(np.diff(block.start_at)[window]):
            live = self._follow(at[part], window[part], live, block, owner_of)
        self._keep(*live[:3], block, owner_of)

    def _follow(self, at, window, live, block: Windows, owner_of):
        """Matches at some places in order, given those that may go on there (side, first place, length, last place); those that may go on behind them.

        A match is a pair of a place here and one in the items; pairs of equal distance (side),
        one after the other, are one longer match.
        """
        n, x = _each(block.start_at, window)
        p, q, size = np.repeat(at, n), block.start[x], np.repeat(block.lengths[window], n)
        order = np.lexsort((p, p - q))
        p, q, size = p[order], q[order], size[order]
        start = np.flatnonzero(np.append(True, (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)))
        side, first, last = (p - q)[start], p[start], p[np.append(start[1:], len(p)) - 1]
        length = last - first + size[start]
        # an earlier match goes on where the first pair of its side is the one behind its last
        head = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        on = head[np.minimum(np.searchsorted(side[head], live[0]), len(head) - 1)]
        goes_on = (side[on] == live[0]) & (first[on] == live[3] + 1)
        on = on[goes_on]
        length[on] += first[on] - live[1][goes_on]
        first[on] = live[1][goes_on]
        ends = ~goes_on & (live[3] < at[-1])
        self._keep(*(v[ends] for v in live[:3]), block, owner_of)
        waits = ~goes_on & ~ends
        open_ = last == at[-1]
        self._keep(side[~open_], first[~open_], length[~open_], block, owner_of)
        return tuple(np.concatenate([v[open_], w[waits]]) for v, w in zip((side, first, length, last), live))

    def _keep(self, side, first, length, block: Windows, owner_of) -> None:
        """Of finished matches the longest of each document."""
        if not len(side):
            return
        q = first - side
        row = np.searchsorted(block.begin, q, side="right") - 1
        doc = owner_of[first]
        best = np.lexsort((q, first, -length, doc))
        best = best[np.append(True, doc[best][1:] != doc[best][:-1])]
        for k in best.tolist():
            d = int(doc[k])
            found = (int(length[k]), int(first[k] - self.first[d]), block.names[row[k]], int(q[k] - block.begin[row[k]]))
            if d not in self.longest or (-found[0], found[1], found[2]) < (-self.longest[d][0], self.longest[d][1], self.longest[d][2]):
                self.longest[d] = found

    def n_hit(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return total[self.first + self.n_words] - total[self.first]

    def spans(self, d: int) -> list[int]:
        """Start and end (exclusive) word numbers of the hit runs of a document, flat."""
        h = self.hit[self.first[d] : self.first[d] + self.n_words[d]].astype(np.int8)
        return np.flatnonzero(np.diff(np.concatenate([[0], h, [0]]))).tolist()


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The benchmark's windows in blocks of at most about block_bytes of text (one longer item: a block of its own)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield Windows([(r.i, r.t) for r in part.collect()], window)


_RESULT = "n_words long, n_hit long, spans array<long>, items array<string>, longest long, longest_at long, longest_item string, longest_item_at long"


def _search(shared: list, column: pa.Array, window: int) -> Shard:
    """A batch held against all blocks."""
    shard = Shard(column, window)
    for block in shared:
        shard.look_up(block.value)
        if len(shared) > KEEP:
            block.__dict__.pop("_value", None)  # a worker reads it again from the file that Spark keeps beside it
    return shard


def _sent(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    return [benchmark.sparkSession.sparkContext.broadcast(block) for block in benchmark_blocks(benchmark, window, block_bytes)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and hits of every document: words, hit words, hit spans and items; and of its longest match the length, first word, item and first word in it (0 and nulls without one)."""
    shared = _sent(benchmark, window, block_bytes)

    def run(batches):
        for batch in pieces(batches):
            m = _search(shared, batch.column("text"), window)
            n_hit, n = m.n_hit(), batch.num_rows
            spans = [m.spans(d) if n_hit[d] else [] for d in range(n)]
            items = [list(m.items.get(d, ())) for d in range(n)]
            longest = [m.longest.get(d, (0, None, None, None)) for d in range(n)]
            columns = zip(("longest", "longest_at", "longest_item", "longest_item_at"), (pa.int64(), pa.int64(), pa.string(), pa.int64()), range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(m.n_words), pa.array(n_hit), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *(pa.array([x[k] for x in longest], t) for _, t, k in columns)],
                ["doc_id", "n_words", "n_hit", "spans", "items", "longest", "longest_at", "longest_item", "longest_item_at"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_RESULT}")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    shared = _sent(benchmark, window, block_bytes)

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(_search(shared, batch.column("text"), window).n_hit() == 0))

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from find_contamination's."""
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )
