"""LM scoring by online logistic context mixing.

A text is a sequence of tokens: lower-cased words, then an end.  A token is coded by
binary decisions.  First, where the preceding word occurred before in the document:
whether its follower comes again.  If not, the bits of a Huffman code of the token's
symbol: the most frequent words and the end have symbols of their own, other words
share one by the octave of their training count, unseen words another one.  Within an
octave a word has its share of the octave's tokens, so no bits are spent on what no
symbol predicts.  Unseen words are one type, as in the unigram base score.

Every code bit is predicted by several contexts: none, the symbol before (exact), two
hashed ones (two symbols before; the last two frequent words, which tell the
language), and what the document itself has shown.  A gated logistic mixer combines
them: weights are chosen by how often the hashed contexts were seen, learned online
from the training documents of the group at hand, and refined by each document's own
past.  Total bits per byte follow from the bits of all decisions.

What the mixer says of a token is the prior of two contexts that hold the real words
before it, whatever their rank: the preceding word, then the two preceding words.
With n tokens of the training documents in a context, c of them the token itself,
P = (c + s P') / (n + s), s = A n ** B, where P' is the shorter context's; s follows n as the
number of different followers does, and as it depends on the context alone, P stays
a distribution.

Counts cover all training documents.  Words, pairs and triples are counted exactly, by
hash and all of them, and each group of documents gets back the counts of its own
(word_counts), so they grow with the training tokens and nothing that grows with the
vocabulary is broadcast.  Only the tables of the symbols' and the spelling's bits have a
fixed size.

Unseen words are one type in `score`, as in the base score.  `bits` adds what it costs to
spell them: the bits of their bytes, predicted from one, two and three bytes before
and mixed in the same way, learned from the training words that occur once.
`bits_per_byte` is that total for the lower-cased words, with one blank between them,
against the bytes of the text.

Learned counts leave the word itself out (a training word seen c times is trained as
one seen c - 1 times), so unseen words have their fair share; so do pairs and triples
when a training document is scored.
Defined results: a null text is empty and consists of the end alone; without training
documents every known count is zero; an empty table gives an empty result; repeated
rows are documents of their own, each counted and scored; further columns of docs are
not read.
"""

from __future__ import annotations

import ctypes
import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_counts
from .pieces import Ragged
from .quality import held_out
from .shared import forget, pieces, written
from .text import LOWER, U64, buffers, mix64, words
from .word_counts import GRAMS, WORDS, Ranges

#: Words with a symbol of their own; octaves of counts; slots of each hashed table.
TOP, OCTAVES, SLOTS = 500, 40, 1 << 19
UNSEEN, END = TOP + OCTAVES, TOP + OCTAVES + 1
SYMBOLS = TOP + OCTAVES + 2
NODES = SYMBOLS - 1
#: The tables one after the other: no context, one symbol, two symbols, two frequent words, repeated followers; spelling by one byte before, two, three.
FOLLOW, LETTERS = 16, 1 << 18
AT = np.cumsum([0, NODES, SYMBOLS * NODES, SLOTS, SLOTS, FOLLOW, 1 << 16, LETTERS, LETTERS])
SPELLED = 5
SLICE = 1 << 15
#: Bytes of text in a group (about), in a range of words' or grams' hashes, and in a partition of groups.
GROUP_BYTES, BUCKET_BYTES, PARTITION_BYTES = 5 << 20, 4 << 20, 24 << 20
#: Documents and tokens that are mixed side by side, and tokens of a document between refinements (doubling).
BLOCK_DOCS, BLOCK_TOKENS, FIRST_STEP, LAST_STEP = 1500, 30_000, 32, 2048
INPUTS, GATES = 5, 6
START = np.array([0.1, 0.35, 0.3, 0.25, 0.1], dtype=np.float32)
#: Weights with which the bytes of a group's first unseen words are mixed, and words that are spelled side by side.
SPELL_START, SPELL_WORDS = np.array([0.2, 0.3, 0.5]), 2000
#: Hashes of the end and of what stands before a document; what parts pairs from triples.
_END, _BEFORE, _PAIR, _TRIPLE = (mix64(np.array([k], dtype=U64))[0] for k in (0xE17D, 0xBEF0, 0x2, 0x3))
#: Bits that the hash of a pair or triple has beyond those that number the corpus's: it meets another one with probability 2**-SPARE_BITS at most.
SPARE_BITS = 8
#: A and B of the two contexts of real words (fixed).
FOLLOWERS = ((8.0, 0.75), (3.0, 0.8))


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with first places and inverse; faster, by one sort of keys and places in one number."""
    size = max(len(keys), 1).bit_length()
    places = np.arange(len(keys), dtype=U64)
    whole = not len(keys) or int(keys.max()) >> (64 - size) == 0
    order = np.sort((keys << U64(size) if whole else keys >> U64(size) << U64(size)) | places)
    place = (order & U64((1 << size) - 1)).astype(np.int64)
    order = keys[place]
    new = np.append(True, order[1:] != order[:-1])[: len(keys)]
    if not whole and (new[1:] & (order[1:] >> U64(size) == order[:-1] >> U64(size))).any():
        return np.unique(keys, return_index=True, return_inverse=True)
    index = np.empty(len(keys), dtype=np.int64)
    index[place] = np.cumsum(new) - 1
    return order[new], place[new], index


class Tokens:
    """Words of the documents of a group and their distinct hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        w = words(data, offsets)
        self.bytes = np.diff(offsets)
        self.length = np.diff(w.first)
        self.first = w.first
        self.hash = w.hash
        self.data, self.start, self.end = data, w.start, w.end
        self.distinct, self.place, self.index = distinct_of(w.hash)


class Grams:
    """Pairs and triples of words that end at each token (a document's end included) of a group, and their distinct hashes."""

    def __init__(self, tokens: Tokens, bits: int = 52):
        self.length, self.bits = tokens.length + 1, bits
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        total = int(self.at[-1])
        self.first, self.last = self.at[:-1], self.at[1:] - 1
        self.inner = np.ones(total, dtype=bool)
        self.inner[self.last] = False
        word = np.full(total, _END, dtype=U64)
        word[self.inner] = tokens.hash
        one = np.append(_BEFORE, word[:-1])[:total]
        one[self.first] = _BEFORE
        two = np.append(_BEFORE, one[:-1])[:total]
        self.later = np.ones(total, dtype=bool)  # tokens with a triple
        self.later[self.first] = False
        self.keys = np.concatenate([mix64(word ^ mix64(one ^ _PAIR)), mix64(word ^ mix64(one ^ mix64(two ^ _TRIPLE)))[self.later]]) >> U64(64 - bits)

    def counted(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and triples in order, and how often the documents marked hold each."""
        train = np.repeat(train, self.length)
        keys = self.keys * U64(2) + np.concatenate([train, train[self.later]])
        keys.sort()
        mark, keys = (keys & U64(1)).astype(np.uint32), keys >> U64(1)
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[start], np.add.reduceat(mark, start) if len(start) else mark

    def index(self) -> None:
        """Sets the place of each token's pair and triple among the distinct ones."""
        total = len(self.inner)
        self.distinct, _, index = distinct_of(self.keys)
        self.keys = None
        self.pair, self.triple = index[:total].astype(np.int32), index[total:].astype(np.int32)

    def contexts(self, tokens: Tokens, word: np.ndarray, gram: np.ndarray, documents: int, held: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(n, c) of each token's contexts from the counts of distinct words and grams; a training document's own token is left out."""
        total = len(self.inner)
        pair, triple = gram[self.pair].astype(np.int64), np.zeros(total, dtype=np.int64)
        triple[self.later] = gram[self.triple]
        own = np.zeros(total, dtype=np.int64)
        own[self.inner] = word[tokens.index]
        one = np.append(0, own[:-1])[:total]
        one[self.first] = documents
        two = np.append(0, pair[:-1])[:total]
        two[self.first] = 0
        out = np.repeat(~held, self.length).astype(np.int64)
        return [(one - out, pair - out), (np.where(self.later, two - out, 0), np.where(self.later, triple - out, 0))]

    def places(self, docs: np.ndarray) -> np.ndarray:
        """The tokens of some documents, one document after the other."""
        n = self.length[docs]
        return np.repeat(self.at[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def with_contexts(bits: np.ndarray, contexts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bits of tokens given the real words before them; `bits` are those of the mixer alone."""
    p = np.exp2(-bits)
    for (a, b), (n, c) in zip(FOLLOWERS, contexts):
        s = a * np.maximum(n, 1) ** b
        p = np.where(n > 0, (c + s * p) / (np.maximum(n, 1) + s), p)
    return -np.log2(p)


def _octave(count: np.ndarray) -> np.ndarray:
    """Symbols of words outside the top by their counts."""
    return np.where(count > 0, TOP + np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), OCTAVES - 1), UNSEEN)


def huffman(frequency: np.ndarray) -> tuple[Ragged, Ragged]:
    """(nodes, bits) on each symbol's way from the root; NODES inner nodes."""
    heap = [(int(f), k, k) for k, f in enumerate(frequency)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    fresh = len(frequency)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    nodes, bits, at = [], [], [0]
    for s in range(len(frequency)):
        way = []
        k = s
        while k in parent:
            way.append((parent[k][0] - len(frequency), parent[k][1]))
            k = parent[k][0]
        nodes += [n for n, _ in reversed(way)]
        bits += [b for _, b in reversed(way)]
        at.append(len(nodes))
    at = np.array(at, dtype=np.int64)
    return Ragged(np.array(nodes, dtype=np.int64), at), Ragged(np.array(bits, dtype=np.int8), at)


class Vocabulary:
    """What all tasks know of the words: totals, the top words, tokens by octave, the code."""

    def __init__(self, total: int, distinct: int, documents: int, octaves: np.ndarray, trained: np.ndarray, top: list[tuple[int, int]]):
        self.documents = documents
        self.total, self.distinct = total + documents, distinct + (documents > 0)
        keys = np.array([h for h, _ in top], dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.symbols = keys[order], order.astype(np.int64)
        frequency = np.ones(SYMBOLS, dtype=np.int64)
        frequency[: len(top)] += np.array([c for _, c in top], dtype=np.int64)
        frequency[TOP : TOP + OCTAVES + 1] += trained
        for _, c in top:  # top words are trained under their own symbols
            octaves[int(_octave(np.array([c]))[0]) - TOP] -= c
            frequency[int(_octave(np.array([c - 1]))[0])] -= c
        frequency[END] += documents
        self.octave_tokens = octaves
        self.nodes, self.bits = huffman(np.maximum(frequency, 1))

    def code(self, keys: np.ndarray, counts: np.ndarray, training: bool) -> np.ndarray:
        """Symbols of words; in training a word's count leaves one occurrence out."""
        out = _octave(counts - 1 if training else counts)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.symbols[at], out)
        return out


class Stream:
    """Tokens of some documents with what their contexts need; each document ends with END."""

    def __init__(self, tokens: Tokens, docs: np.ndarray, symbol: np.ndarray):
        length = tokens.length[docs]
        self.length = length + 1
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        total = int(self.at[-1])
        doc = np.repeat(np.arange(len(docs)), self.length)
        place = np.arange(total) - self.at[:-1][doc]
        self.doc, self.place = doc, place
        last = place == length[doc]
        word = np.where(last, 0, tokens.first[docs][doc] + place) if len(tokens.hash) else np.zeros(total, np.int64)
        word = np.minimum(word, max(len(tokens.hash) - 1, 0))
        self.distinct = np.where(last, -1, tokens.index[word]) if len(tokens.hash) else np.full(total, -1)
        self.symbol = np.where(last, END, symbol[self.distinct]) if len(symbol) else np.full(total, END)
        before = np.append(END, self.symbol[:-1])
        self.one = np.where(place > 0, before, END)
        two = np.append(END, self.one[:-1])
        self.two = np.where(place > 0, two, END)
        # the last two frequent words
        frequent = np.flatnonzero(self.symbol < TOP)
        rank = np.searchsorted(frequent, np.arange(total)) - 1
        floor = np.searchsorted(frequent, self.at[:-1])[doc]
        value = lambda r: np.where(r >= floor, self.symbol[frequent[np.maximum(r, 0)]] if len(frequent) else 0, END)
        self.frequent = value(rank) * SYMBOLS + value(rank - 1)
        self._followers(tokens, docs, total)

    def _followers(self, tokens, docs, total):
        """hit: whether the token follows the preceding word as that word's last occurrence was followed; run: hits just before; open: whether there was one."""
        key = np.append(-1, self.distinct[:-1])
        key = np.where(self.place > 0, key, -1)
        # by document, word and place: one number where it fits
        wide = (int(key.max()) + 2) * len(docs) * (total + 1) >= 1 << 62 if total else False
        owner = self.doc * (int(key.max()) + 2 if total else 1) + key + 1
        order = np.argsort(owner, kind="stable") if wide else np.sort(owner * total + np.arange(total)) % max(total, 1)
        same = np.zeros(total, dtype=bool)
        same[1:] = owner[order][1:] == owner[order][:-1]
        earlier = np.full(total, -1)
        earlier[order[1:]] = np.where(same[1:], order[:-1], -1)
        self.open = (earlier >= 0) & (key >= 0)
        guess = np.where(self.open, self.distinct[np.maximum(earlier, 0)], -2)
        self.hit = self.open & (guess == self.distinct)
        miss = np.maximum.accumulate(np.where(~self.hit, np.arange(total), -1))
        before = np.append(-1, miss[:-1])
        run = np.arange(total) - 1 - np.maximum(before, self.at[:-1][self.doc] - 1)
        self.run = np.clip(run, 0, FOLLOW - 1)

    def expand(self, which: np.ndarray, vocabulary: Vocabulary):
        """Code bits of the given tokens: (token, node, bit, slots of the four tables)."""
        symbol = self.symbol[which]
        size = vocabulary.nodes.lengths(symbol)
        token = np.repeat(which, size)
        node, bit = vocabulary.nodes.take(symbol), vocabulary.bits.take(symbol)
        one = AT[1] + self.one[token] * NODES + node
        two = AT[2] + _slot(self.two[token] * SYMBOLS + self.one[token], node)
        far = AT[3] + _slot(self.frequent[token] + (1 << 40), node)
        return token, node, bit, (node, one, two, far)


def _slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = (context * 1024 + node).astype(U64) * U64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(45)).astype(np.int64)


assert SLOTS == 1 << (64 - 45)


def add_bits(counts: np.ndarray, slot: np.ndarray, bit: np.ndarray, times=np.uint32(1)) -> None:
    """Add bits to the counts (slot, bit)."""
    np.add.at(counts.reshape(-1), slot * 2 + bit, times)


def train_counts(stream: Stream, vocabulary: Vocabulary, counts: np.ndarray) -> None:
    """Add the bits of training documents to counts (slot, bit)."""
    add_bits(counts, AT[4] + stream.run[stream.open], stream.hit[stream.open].astype(np.int64))
    coded = np.flatnonzero(~stream.hit)
    for a in range(0, len(coded), BLOCK_TOKENS):
        _, _, bit, slots = stream.expand(coded[a : a + BLOCK_TOKENS], vocabulary)
        for slot in slots:
            add_bits(counts, slot, bit)


class Tables:
    """Predictions of all slots on the logistic scale, and how often each was seen (in three steps)."""

    def __init__(self, counts: np.ndarray):
        n0, n1 = counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64)
        n = n0 + n1
        self.stretch = np.where(n < 3, 0, np.log((n1 + 0.3) / (n0 + 0.3)) * n / (n + 1.5)).astype(np.float32)
        self.seen = ((n >= 3).astype(np.int8) + (n >= 40)).astype(np.int8)
        follow = counts[AT[4] : AT[5]].astype(np.float64)
        self.follow = (follow[:, 1] + 0.5) / (follow.sum(axis=1) + 1.0)


class Spelling:
    """The bytes of some distinct words, each word closed by a blank, with the three bytes before each (blanks before the word)."""

    def __init__(self, tokens: Tokens, which: np.ndarray):
        begin, size = tokens.start[tokens.place[which]], (tokens.end - tokens.start)[tokens.place[which]] + 1
        self.first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(self.first, size)
        at = np.minimum(np.repeat(begin, size) + place, max(len(tokens.data) - 1, 0))
        byte = np.where(place == np.repeat(size - 1, size), 0x20, LOWER[tokens.data[at]] if len(tokens.data) else 0x20).astype(np.uint32)
        self.key = byte.copy()
        for k in (1, 2, 3):
            self.key |= np.where(place >= k, np.roll(byte, k), np.uint32(0x20)) << np.uint32(8 * k)

    @staticmethod
    def bits(key: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Eight code bits of each byte and their slots in the tables of one, two and three bytes before."""
        step = np.arange(8)
        byte = (key & 0xFF).astype(np.int64)[:, None]
        node = ((1 << step) | (byte >> (8 - step))).reshape(-1)
        before = np.repeat(key.astype(np.int64) >> 8, 8)
        fold = lambda context: ((context << 8 | node).astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(46)).astype(np.int64)
        slots = (AT[SPELLED] + ((before & 0xFF) << 8 | node), AT[SPELLED + 1] + fold(before & 0xFFFF), AT[SPELLED + 2] + fold(before | 1 << 24))
        return ((byte >> (7 - step)) & 1).reshape(-1), slots

    def train(self, counts: np.ndarray) -> None:
        key, times = np.unique(self.key, return_counts=True)
        bit, slots = self.bits(key)
        for slot in slots:
            add_bits(counts, slot, bit, np.repeat(times.astype(np.uint32), 8))

    def cost(self, tables: Tables) -> np.ndarray:
        """Bits of each word; weights by how often the longer contexts were seen, learned online over the words."""
        out = np.zeros(len(self.first))
        weights = np.tile(SPELL_START, (9, 1))
        for a in range(0, len(self.first), SPELL_WORDS):
            low, high = self.first[a], self.first[a + SPELL_WORDS] if a + SPELL_WORDS < len(self.first) else len(self.key)
            bit, slots = self.bits(self.key[low:high])
            x = np.stack([tables.stretch[s] for s in slots]).astype(np.float64)
            gate = tables.seen[slots[1]].astype(np.int64) * 3 + tables.seen[slots[2]]
            p = np.clip(1 / (1 + np.exp(-np.clip((weights[gate].T * x).sum(axis=0), -9, 9))), 1e-4, 1 - 1e-4)
            out[a : a + SPELL_WORDS] = np.add.reduceat(-np.log2(np.abs(1 - bit - p)), 8 * (self.first[a : a + SPELL_WORDS] - low))
            for k in range(len(x)):
                up, down = np.bincount(gate, weights=(bit - p) * x[k], minlength=9), np.bincount(gate, weights=p * (1 - p) * x[k] ** 2, minlength=9)
                weights[:, k] += 0.25 * up / (down + 200)
        return out


assert LETTERS == 1 << (64 - 46)


class Mixer:
    """Gated weights, learned online over the documents of a group."""

    def __init__(self):
        self.weights = np.tile(START, (GATES, 1)).astype(np.float32)

    def score(self, stream: Stream, vocabulary: Vocabulary, tables: Tables, within: np.ndarray, training: np.ndarray) -> np.ndarray:
        """Bits of each token; `within` are bits of words given their symbols, `training` marks documents that teach the shared weights."""
        docs = len(stream.length)
        p = tables.follow[stream.run]
        out = np.where(stream.open, -np.log2(np.where(stream.hit, p, 1 - p)), 0.0)
        coded = ~stream.hit
        inner = coded & (stream.distinct >= 0)
        out[inner] += within[stream.distinct[inner]]
        own = np.zeros(docs * NODES * 2, dtype=np.float32)
        delta = np.zeros((docs, INPUTS), dtype=np.float32)
        step, low = FIRST_STEP, 0
        longest = int(stream.length.max()) if docs else 0
        while low < longest:
            high = low + step
            alive = np.flatnonzero(stream.length > low)
            size = np.minimum(stream.length[alive], high) - low
            cut = np.concatenate([[0], np.cumsum(size)])
            a = 0
            while a < len(alive):
                b = max(a + 1, int(np.searchsorted(cut, cut[a] + BLOCK_TOKENS, side="right")) - 1)
                n = size[a:b]
                which = np.repeat(stream.at[alive[a:b]] + low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self._step(stream, vocabulary, tables, which[coded[which]], own, delta, training, out)
                a = b
            low, step = high, min(step * 2, LAST_STEP)
        return out

    def _step(self, stream, vocabulary, tables, which, own, delta, training, out):
        if not len(which):
            return
        token, node, bit, slots = stream.expand(which, vocabulary)
        doc = stream.doc[token]
        one = np.float32(1)
        x = np.empty((INPUTS, len(token)), dtype=np.float32)
        for k, s in enumerate(slots):
            np.take(tables.stretch, s, out=x[k])
        place = (doc * NODES + node) * 2
        zeros, ones = own[place], own[place + 1]
        total = zeros + ones
        x[4] = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))) * (total / (total + 2 * one))
        gate = tables.seen[slots[2]].astype(np.int64) * 2 + (tables.seen[slots[3]] > 1)
        odds = np.zeros(len(token), dtype=np.float32)
        for k in range(INPUTS):
            odds += (self.weights[gate, k] + delta[doc, k]) * x[k]
        p = np.clip(one / (one + np.exp(-np.clip(odds, -9, 9))), np.float32(1e-4), np.float32(1 - 1e-4))
        bits = bit.astype(np.float32)
        cost = -np.log2(np.abs(one - bits - p))
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        out[token[start]] += np.add.reduceat(cost, start, dtype=np.float64)
        # tokens come document by document
        edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        here = doc[edge]
        error, spread = bits - p, p * (one - p)
        teach = training[doc]
        every = bool(teach.all())
        for k in range(INPUTS):
            push, curve = error * x[k], spread * x[k] * x[k]
            if every or teach.any():
                g, a, b = (gate, push, curve) if every else (gate[teach], push[teach], curve[teach])
                up, down = np.bincount(g, weights=a, minlength=GATES), np.bincount(g, weights=b, minlength=GATES)
                self.weights[:, k] += (0.25 * up / (down + 200)).astype(np.float32)
            up, down = np.add.reduceat(push, edge, dtype=np.float64), np.add.reduceat(curve, edge, dtype=np.float64)
            delta[here, k] = 0.98 * delta[here, k] + (0.1 * up / (down + 30)).astype(np.float32)
        np.add.at(own, place + bit, one)


def _tidy(run):
    """run, after which a worker's free memory goes back to the system."""
    def tidy(*tables):
        out = run(*tables)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        return out

    return (lambda docs: tidy(docs)) if run.__code__.co_argcount == 1 else (lambda docs, answers: tidy(docs, answers))


def _box(rows: list[pa.RecordBatch]) -> bytes:
    """The documents of a group as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for r in rows:
            out.write_batch(r)
    return sink.getvalue().to_pybytes()


def _unbox(box: bytes) -> pa.Table:
    return pa.ipc.open_stream(box).read_all()


def _boxer(batches):
    """Groups of about GROUP_BYTES of text, one row each, in the order in which a partition holds its documents; train: how many train."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def group():
        nonlocal seq, held, size
        train = sum(r.num_rows - pc.sum(r.column("held").cast(pa.int64())).as_py() for r in held)
        row = pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([train], pa.int64()), pa.array([_box(held)], pa.binary())], ["group", "train", "box"])
        seq, held, size = seq + 1, [], 0
        return row

    for batch in pieces(batches):
        if batch.num_rows:
            if held and size + batch.nbytes > GROUP_BYTES:
                yield group()
            held.append(batch)
            size += batch.nbytes
    if held:
        yield group()


def _asker(ranges: dict[int, Ranges], bits: int):
    """For groups: their distinct words, pairs and triples, with their training counts."""
    def run(batches):
        for batch in batches:
            for group, box in zip(batch.column("group").to_pylist(), batch.column("box")):
                rows = _asks_of(group, _unbox(box.as_py()), ranges, bits)
                yield from word_counts.table(rows).to_batches(max_chunksize=256)

    return run


def _asks_of(group: int, docs: pa.Table, ranges: dict[int, Ranges], bits: int) -> list[tuple]:
    tokens = Tokens(docs.column("text"))
    held = docs.column("held").to_numpy()
    train = np.repeat(~held, tokens.length)
    counts = np.bincount(tokens.index[train], minlength=len(tokens.distinct))
    rows = word_counts.asks(WORDS, group, tokens.distinct, counts, ranges[WORDS])
    keys, counts = Grams(tokens, bits).counted(~held)
    return rows + word_counts.asks(GRAMS, group, keys, counts, ranges[GRAMS])


def _sums_of_words(keys: np.ndarray, total: np.ndarray) -> tuple[bytes, bytes]:
    """Of a range of words: the most frequent ones; tokens, known words, tokens by octave of the count and of the count less one, and the frequent words' counts."""
    known = total > 0
    octave = np.bincount(_octave(total[known]) - TOP, weights=total[known], minlength=OCTAVES + 1)
    trained = np.bincount(_octave(total[known] - 1) - TOP, weights=total[known], minlength=OCTAVES + 1)
    sums = np.concatenate([[total.sum(), known.sum()], octave, trained]).astype(np.int64)
    best = np.lexsort((keys, -total))[:TOP]
    best = best[total[best] > 1]
    return keys[best].tobytes(), sums.tobytes() + total[best].astype(np.int64).tobytes()


def _blocks(docs: np.ndarray):
    for a in range(0, len(docs), BLOCK_DOCS):
        yield docs[a : a + BLOCK_DOCS]


def _trainer(shared, ranges: dict[int, Ranges]):
    """For a group: its counts of all table slots, in slices (only those with counts)."""
    def run(boxes: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unbox(boxes.column("box")[0].as_py())
        vocabulary = shared.value
        tokens = Tokens(docs.column("text"))
        total = word_counts.answered(answers, WORDS, tokens.distinct, ranges[WORDS]).astype(np.int64)
        symbol = vocabulary.code(tokens.distinct, total, True)
        counts = np.zeros((AT[-1], 2), dtype=np.uint32)
        train = ~docs.column("held").to_numpy()
        for some in _blocks(np.flatnonzero(train)):
            train_counts(Stream(tokens, some, symbol), vocabulary, counts)
        # a training word that occurs once is what an unseen word will be
        once = np.flatnonzero((total == 1) & (np.bincount(tokens.index[np.repeat(train, tokens.length)], minlength=len(total)) > 0))
        Spelling(tokens, once).train(counts)
        parts = [counts[a : a + SLICE] for a in range(0, len(counts), SLICE)]
        return pa.table({"slice": pa.array([k for k, p in enumerate(parts) if p.any()], pa.int32()), "counts": pa.array([p.tobytes() for p in parts if p.any()], pa.binary())})

    return run


def _add_slices(batches):
    """Adds up equal slices of a partition; one compressed row each."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
            total[k] = total[k] + part if k in total else part
    press = zstandard.ZstdCompressor(level=1)
    part = TaskContext.get().partitionId() % 32
    for k, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([press.compress(v.tobytes())], pa.binary())], ["slice", "part", "counts"])


def _sum_slices(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.int64) for raw in rows.column("counts").to_pylist())
    return pa.table({"slice": rows.column("slice")[:1], "part": pa.array([0], pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, bits_per_byte double"


def _scorer(shared, ranges: dict[int, Ranges], gram_bits: int):
    def run(boxes: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unbox(boxes.column("box")[0].as_py())
        vocabulary, tables = shared.value
        tokens = Tokens(docs.column("text"))
        held = docs.column("held").to_numpy()
        counts = word_counts.answered(answers, WORDS, tokens.distinct, ranges[WORDS]).astype(np.int64)
        symbol = vocabulary.code(tokens.distinct, counts, False)
        space = np.log10(vocabulary.total + vocabulary.distinct + 1.0)
        end = np.log10(vocabulary.documents + 1.0) - space
        at = tokens.first
        by_document = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[tokens.index])])[at]) if len(tokens.hash) else np.zeros(len(at) - 1, dtype=x.dtype)
        base = by_document(np.log10(counts + 1.0) - space) + end
        n_known = by_document((counts > 0).astype(np.int64)) + (vocabulary.documents > 0)
        shared_symbol = (symbol >= TOP) & (symbol < UNSEEN)
        within = np.zeros(len(symbol))
        within[shared_symbol] = np.log2(np.maximum(vocabulary.octave_tokens[symbol[shared_symbol] - TOP], counts[shared_symbol]) / counts[shared_symbol])
        unseen = np.flatnonzero(counts == 0)
        spelled = np.zeros(len(symbol))
        spelled[unseen] = Spelling(tokens, unseen).cost(tables)
        grams = Grams(tokens, gram_bits)
        grams.index()
        contexts = grams.contexts(tokens, counts, word_counts.answered(answers, GRAMS, grams.distinct, ranges[GRAMS]), vocabulary.documents, held)
        del grams.pair, grams.triple, grams.distinct
        mixer, bits = Mixer(), np.zeros(docs.num_rows)
        # training documents first: what they teach serves all others of the group
        for some in _blocks(np.argsort(held, kind="stable")):
            stream, places = Stream(tokens, some, symbol), grams.places(some)
            spent = with_contexts(mixer.score(stream, vocabulary, tables, within, ~held[some]), [(n[places], c[places]) for n, c in contexts])
            bits[some] = np.add.reduceat(spent, stream.at[:-1])
        n, total = docs.num_rows, bits + by_document(spelled)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held"), "n_tokens": pa.array(tokens.length + 1), "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(n, vocabulary.total, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(-bits * np.log10(2)), "bits": pa.array(total), "bits_per_byte": pa.array(total / np.maximum(tokens.bytes, 1)),
        })

    return run


def score_documents(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte) for every row of docs.

    doc_id is an integer column.  Documents with crc32(doc_id as text) mod `mod` equal to
    `rest` are held out.  Documents that lie together make a group, so repeated rows
    spread like others.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    bits = min(60, SPARE_BITS + math.ceil(math.log2(total + 2)))
    ranges = {WORDS: Ranges(64, max(1, buckets // 4)), GRAMS: Ranges(bits, buckets)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), mod, rest).alias("held"))
    # written as groups, so that every pass and every repeated task sees the same ones, and texts are never shuffled one by one
    groups = written(rows.mapInArrow(_boxer, "group long, train long, box binary"), "groups")
    number, documents = groups.agg(F.count("*"), F.coalesce(F.sum("train"), F.lit(0))).first()
    parts = int(max(1, min(number, max(2 * spark.sparkContext.defaultParallelism, total // PARTITION_BYTES))))
    boxes = groups.select("group", "box").repartition(parts, "group")
    asked = boxes.mapInArrow(_asker(ranges, bits), word_counts.COLUMNS)
    answers = written(word_counts.totals(asked, ranges, _sums_of_words, number), "answers")

    sums = np.zeros(2 + 2 * (OCTAVES + 1), dtype=np.int64)
    found = answers.filter(F.col("kind") == word_counts.SUMS).select("keys", "counts")
    head = 8 * len(sums)
    for i, x in found.mapInArrow(_head_sums(head), "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[i] = x
    top = found.mapInArrow(_top_words(head), "hash long, count long").orderBy(F.desc("count"), "hash").limit(TOP).collect()
    vocabulary = Vocabulary(int(sums[0]), int(sums[1]), documents, sums[2 : 3 + OCTAVES], sums[3 + OCTAVES :], [(r["hash"], r["count"]) for r in top])

    by_group = lambda rows: rows.repartition(parts, "group").groupBy("group")
    answer = answers.filter(F.col("kind") != word_counts.SUMS).select(F.col("owner").alias("group"), "kind", "bucket", "counts")
    known = spark.sparkContext.broadcast(vocabulary)
    slices = boxes.groupBy("group").cogroup(by_group(answer.filter(F.col("kind") == WORDS))).applyInArrow(_tidy(_trainer(known, ranges)), "slice int, counts binary")
    schema = "slice int, part int, counts binary"
    slices = written(slices.mapInArrow(_add_slices, schema).groupBy("slice", "part").applyInArrow(_sum_slices, schema).groupBy("slice").applyInArrow(_sum_slices, schema), "slices")
    counts = np.zeros((-(-int(AT[-1]) // SLICE) * SLICE, 2), dtype=np.int64)
    for r in slices.toLocalIterator():  # a table of fixed size
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), dtype=np.int64).reshape(-1, 2)
        counts[r.slice * SLICE : r.slice * SLICE + len(part)] = part
    model = spark.sparkContext.broadcast((vocabulary, Tables(counts[: AT[-1]])))
    scores = written(boxes.groupBy("group").cogroup(by_group(answer)).applyInArrow(_tidy(_scorer(model, ranges, bits)), _SCORES), "scores")
    forget(answers, groups, slices)
    return scores


def _head_sums(head: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                total = sum(np.frombuffer(c[:head], dtype=np.int64) for c in batch.column("counts").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    return run


def _top_words(head: int):
    def run(batches):
        for batch in batches:
            for h, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, dtype=np.int64)), pa.array(np.frombuffer(c[head:], dtype=np.int64))], ["hash", "count"])

    return run
