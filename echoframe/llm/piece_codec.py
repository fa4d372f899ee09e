"""Encoding and decoding with a merge-type sentencepiece vocabulary, through an agenda of symbol pairs.

Texts are cut where no piece has the two bytes side by side, so that no merge crosses a
cut.  The symbols of all chunks that a worker hasn't met start as their characters.  The
agenda holds the adjacent pairs that make a piece, highest score first and from left to
right among equal ones.  The pair taken becomes one symbol and its new neighbours enter the
agenda, until it is empty.  Short chunks are many: each has its agenda in a ragged array, and
one step takes the best pair off every one of them.  Long chunks share an agenda that is
sorted at first, with a heap for the pairs that come up; entries that no longer hold are
passed over.  What is in no piece is given as its UTF-8 bytes.  Each worker remembers the ids
of distinct chunks.

Decoding joins the bytes of the pieces and drops the mark that stands before every text;
bytes that are no UTF-8 become U+FFFD one by one.

Both ways are checked against the library in every Arrow batch, and a difference is an
error: the chunks that a worker meets for the first time by its encode(), and the ids of all whole texts by its decode().

Defined results: a null or empty text has the begin and end ids alone and decodes to the
empty text; an empty table gives an empty result; very long texts are encoded whole;
repeated rows give repeated results; doc_id may be of any type and null; further columns are
not read.  A mark (U+2581) in a text is as good as a blank, as it is to the library.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .pieces import Cache, Ragged, hash_spans
from .shared import pieces
from .text import buffers
from .token_counts import MergeTable

_MARK = "▁"
#: Distinct chunks that a worker remembers.
DISTINCT = 500_000
#: Chunks, and ids of whole texts, that the library checks at once; it holds more than a hundred bytes an id meanwhile.
CHECKED, CHECKED_IDS = 20_000, 1 << 16
#: Symbols that are worked on together (or one longer chunk), and symbols of a chunk from which on its pairs are taken one by one.
TOGETHER, LONG = 1 << 16, 64
#: Bytes of text that are worked on together (or one text).
BYTES = 1 << 20
_GONE, _WALL = -(1 << 31), -(1 << 31) + 1
_BITS = 40
_PLACE, _LAST, _NO_RANK = (1 << _BITS) - 1, (1 << 62), 2**31 - 1


def _column(values: np.ndarray) -> list[int] | array:
    """Numbers to be changed one by one: a list, or an array where there are many."""
    return values.tolist() if len(values) <= 8 * TOGETHER else array("q", values.astype(np.int64).tobytes())


class Agenda:
    """The pairs of a vocabulary in order of score, and the merging of symbols by them."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.made = dict(zip(table.keys.tolist(), zip(table.ranks.tolist(), table.merged.tolist())))

    def symbols(self, texts: list[str]) -> Ragged:
        """Symbols of each text; a character in no piece is minus its code point, less one."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.table.points, points), len(self.table.points) - 1)
        flat = np.where(self.table.points[at] == points, self.table.symbols[at], -1 - points.astype(np.int64))
        return Ragged(flat.astype(np.int32), np.append(0, np.cumsum([len(t) for t in texts])))

    def merged(self, rows: Ragged) -> Ragged:
        """The symbols left in each row when its agenda is empty."""
        size = np.diff(rows.at)
        order, parts, lengths, k = np.argsort(size, kind="stable"), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(size[order])
        while k < len(order):
            upto = max(k + 1, int(np.searchsorted(ends, ends[k] + TOGETHER)))
            some = order[k:upto]
            # a symbol that pairs with none stands before each row and at the end
            walls = np.append(0, np.cumsum(size[some] + 1))
            flat = np.full(walls[-1] + 1, _WALL, dtype=np.int32)
            inside = np.ones(len(flat), dtype=bool)
            inside[walls] = False
            flat[inside] = rows.take(some)
            if size[some[-1]] > LONG:
                out = self._alone(flat)
                left = inside & (out != _GONE)
                done = Ragged(out[left], np.append(0, np.cumsum(left))[walls])
            else:
                done = self._in_step(flat, walls[:-1])
            parts.append(done.flat)
            lengths.append(np.diff(done.at))
            k = upto
        both = Ragged(np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(lengths))))
        back = np.argsort(order)
        return Ragged(both.take(back), np.append(0, np.cumsum(both.lengths(back))))

    def _in_step(self, s: np.ndarray, walls: np.ndarray) -> Ragged:
        """Rows of s, which walls set apart: each step takes the best pair off the agenda of every row."""
        rank, made = self.table.look_up(s[:-1], s[1:])
        rank, made = np.append(rank, _NO_RANK), np.append(made, 0)
        row, parts, rows, lengths = np.arange(len(walls)), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(walls):
            top = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(s)), walls)
            going = top >> 32 != _NO_RANK
            if not going.all():
                stays = np.repeat(going, np.diff(np.append(walls, len(s) - 1)))
                done = ~stays & (s[:-1] != _WALL)
                parts.append(s[:-1][done])
                rows.append(row[~going])
                lengths.append(np.diff(np.append(walls, len(s) - 1))[~going] - 1)
                shift = np.cumsum(np.append(0, ~stays))
                top = top[going] - shift[top[going] & 0xFFFFFFFF]
                walls, row = walls[going] - shift[walls[going]], row[going]
                stays = np.append(stays, True)
                s, rank, made = s[stays], rank[stays], made[stays]
                if not len(walls):
                    break
            x = top & 0xFFFFFFFF
            s[x] = made[x]
            keep = np.ones(len(s), dtype=bool)
            keep[x + 1] = False
            s, rank, made = s[keep], rank[keep], made[keep]
            walls, x = walls - np.arange(len(walls)), x - np.arange(len(x))
            for at in (x - 1, x):  # the pairs beside the new symbols enter their agendas
                rank[at], made[at] = self.table.look_up(s[at], s[at + 1])
        order = np.argsort(np.concatenate(rows))
        both = Ragged(np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(lengths))))
        return Ragged(both.take(order), np.append(0, np.cumsum(both.lengths(order))))

    def _alone(self, flat: np.ndarray) -> np.ndarray:
        """One agenda for all of flat: pairs of best score first, and from left to right among equal ones."""
        n, size, made = len(flat), self.table.size, self.made
        rank, symbol = self.table.look_up(flat[:-1], flat[1:])
        at = np.flatnonzero(rank != _NO_RANK)
        entry = (rank[at].astype(np.int64) << _BITS) | at
        # per place the entry that holds now, and what it makes
        holds = np.full(n, -1, dtype=np.int64)
        holds[at] = entry
        holds, makes = _column(holds), _column(symbol)
        # the agenda: the pairs at hand in order, and a heap of those that come up
        ready = np.sort(entry).tolist()
        ready.append(_LAST)
        s, after, before, new, k = _column(flat), _column(np.arange(1, n + 1)), _column(np.arange(-1, n - 1)), [_LAST], 0
        while True:
            top = ready[k]
            if top < new[0]:
                k += 1
            else:
                top = heappop(new)
                if top == _LAST:
                    break
            x = top & _PLACE
            if holds[x] != top:
                continue  # one of the two has changed meanwhile
            y = after[x]
            c = s[x] = makes[x]
            s[y], holds[y] = _GONE, -1
            y = after[x] = after[y]
            before[y] = x
            b = s[y]
            pair = made.get(c * size + b) if b >= 0 else None
            if pair:
                holds[x], makes[x] = pair[0] << _BITS | x, pair[1]
                heappush(new, holds[x])
            else:
                holds[x] = -1
            y = before[x]
            a = s[y]
            if a >= 0:
                pair = made.get(a * size + c)
                if pair:
                    holds[y], makes[y] = pair[0] << _BITS | y, pair[1]
                    heappush(new, holds[y])
                else:
                    holds[y] = -1
        return np.array(s, dtype=np.int32)


class Codec:
    """Ids of texts and texts of ids, as the library gives them."""

    def __init__(self, path: str, check: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.table = MergeTable(path)
        self.agenda = Agenda(self.table)
        self.check = check
        self.cache = Cache(DISTINCT)
        n = self.model.get_piece_size()
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        at = {self.model.id_to_piece(i): i for i in range(n) if self.model.is_byte(i)}
        self.byte = np.array([at.get(f"<0x{b:02X}>", -1) for b in range(256)], dtype=np.int32)
        if (self.byte < 0).any():
            raise ValueError(f"{path}: no byte pieces, so unknown characters have no ids")
        kinds = [self.model.is_byte, self.model.is_control, self.model.is_unknown]
        spelled = []
        for i in range(n):
            byte, control, unknown = (kind(i) for kind in kinds)
            piece = self.model.id_to_piece(i)
            spelled.append(bytes([int(piece[3:5], 16)]) if byte else b"" if control else " ⁇ ".encode() if unknown else piece.replace(_MARK, " ").encode())
        self.spelled = Ragged(np.frombuffer(b"".join(spelled), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in spelled])))
        self.marked = np.array([x[:1] == b" " and not (kinds[0](i) or kinds[2](i)) for i, x in enumerate(spelled)])
        self.is_byte, self.is_control = (np.array([kind(i) for i in range(n)]) for kind in kinds[:2])
        #: bytes that stand side by side in some piece or character; no merge crosses other pairs of bytes
        self.joined = np.zeros((256, 256), dtype=bool)
        self.joined[:, 0x80:0xC0] = True
        for p in self.table.number:
            raw = np.frombuffer(p.replace(_MARK, " ").encode(), dtype=np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        #: a byte that joins with none sets chunks apart for the library
        self.wall = next((chr(b) for b in range(128) if not (self.joined[b, :0x80].any() or self.joined[b, 0xC0:].any() or self.joined[:, b].any())), None)
        #: characters of pieces that are no pieces themselves
        self.spare = {i: p for p, i in self.table.number.items() if i >= n}
        for text in ("", " ", "a  b", "\tx\n\ny ", "ＡＢ ﬁ ①", "é 日本語 😀\u0000", "<s> </s>", "▁a"):
            ids = self.encode(*buffers(pa.array([text], pa.large_string())))
            if ids.flat.tolist() != self.model.encode(text):
                raise ValueError(f"{path}: its normaliser or pieces are not those that these rules encode")

    def _chunks(self, data: np.ndarray, offsets: np.ndarray):
        """The texts with a blank before each that isn't empty; where chunks start and end in them; offsets."""
        if _MARK.encode() in (raw := data.tobytes()):
            data, offsets = buffers(pa.array([raw[a:b].decode().replace(_MARK, " ") for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string()))
        filled = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][filled], 0x20)
        offsets = offsets + np.append(0, np.cumsum(filled))
        start = np.zeros(len(data) + 1, dtype=bool)
        start[1:-1] = ~self.joined[data[:-1], data[1:]]
        start[offsets] = True
        starts = np.flatnonzero(start[:-1])
        return data, starts, np.append(starts[1:], len(data))[: len(starts)], offsets

    def _ids(self, chunks: list[bytes]) -> Ragged:
        """Ids of single chunks, through the agenda."""
        rows = self.agenda.merged(self.agenda.symbols([c.decode().replace(" ", _MARK) for c in chunks]))
        odd = np.flatnonzero((rows.flat < 0) | (rows.flat >= len(self.is_byte)))
        if not len(odd):
            return rows
        parts = [self.byte[list((self.spare[s] if s >= 0 else chr(-1 - s)).encode())] for s in rows.flat[odd].tolist()]
        length = np.ones(len(rows.flat), dtype=np.int64)
        length[odd] = [len(p) for p in parts]
        at = np.append(0, np.cumsum(length))
        out = np.repeat(rows.flat, length)
        for k, p in zip(at[odd], parts):
            out[k : k + len(p)] = p
        return Ragged(out, at[rows.at])

    def _checked(self, chunks: list[bytes], ids: Ragged) -> None:
        """New chunks against the library, in texts in which a wall stands before each."""
        if self.wall is None:
            raise ValueError("every character joins with others in some piece, so chunks can't be checked")
        wall = self.byte[ord(self.wall)]
        for a in range(0, len(chunks), CHECKED):
            some = chunks[a : a + CHECKED]
            want = np.array(self.model.encode(self.wall + self.wall.join(c.decode() for c in some)), dtype=np.int32)
            starts = ids.at[a : a + len(some)] - ids.at[a]
            got = np.insert(ids.flat[ids.at[a] : ids.at[a + len(some)]], starts, wall)
            if len(want) != len(got) + 1 or (want[1:] != got).any() or (got[starts + np.arange(len(some))] != wall).any():
                raise ValueError("the agenda's ids are not those of the library")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Ragged:
        """Ids of each text of a buffer, without begin and end."""
        data, starts, ends, offsets = self._chunks(data, offsets)
        coded = pa.array(hash_spans(data, starts, ends)).dictionary_encode()
        keys, order = coded.dictionary.to_numpy(), np.argsort(coded.dictionary.to_numpy())
        inverse, first = coded.indices.to_numpy(), np.empty(len(keys), dtype=np.int64)
        first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
        keys, first, inverse = keys[order], first[order], np.argsort(order)[inverse]
        new = np.flatnonzero(self.cache.missing(keys))
        if len(self.cache.keys) + len(new) > self.cache.most:
            self.cache.clear()
            new = np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            chunks = [raw[starts[k] : ends[k]] for k in first[new]]
            ids = self._ids(chunks)
            if self.check:
                self._checked(chunks, ids)
            self.cache.add(keys[new], ids)
        row = np.searchsorted(self.cache.keys, keys)
        total = np.append(0, np.cumsum(self.cache.rows.lengths(row)[inverse]))
        row = row[inverse]
        return Ragged(self.cache.rows.take(row), total[np.searchsorted(starts, offsets)])

    def framed(self, ids: Ragged) -> Ragged:
        """The ids of each text with begin and end."""
        docs = np.arange(len(ids.at) - 1)
        at = ids.at + 2 * np.append(docs, len(docs))
        out = np.empty(at[-1], dtype=np.int32)
        inside = np.ones(len(out), dtype=bool)
        inside[at[:-1]] = inside[at[1:] - 1] = False
        out[at[:-1]], out[at[1:] - 1], out[inside] = self.begin, self.end, ids.flat
        return Ragged(out, at)

    def decode(self, ids: Ragged) -> list[bytes]:
        """The UTF-8 text of each row of ids."""
        raw = self.spelled.take(ids.flat).tobytes()
        at = np.append(0, np.cumsum(self.spelled.lengths(ids.flat)))[ids.at]
        byte, spoken = np.append(0, np.cumsum(self.is_byte[ids.flat])), np.flatnonzero(~self.is_control[ids.flat])
        # the mark before a text is that of the first id which isn't a control
        first = np.append(spoken, len(ids.flat))[np.searchsorted(spoken, ids.at[:-1])]
        marked = np.append(self.marked[ids.flat], False)[first] & (first < ids.at[1:])
        out = []
        for k, (a, b, cut) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), marked.tolist())):
            text = raw[a + cut : b]
            if byte[ids.at[k + 1]] > byte[ids.at[k]]:
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self._mended(ids.flat[ids.at[k] : ids.at[k + 1]])[cut:]
            out.append(text)
        if self.check:
            k = 0
            while k < len(out):
                upto = max(k + 1, int(np.searchsorted(ids.at, ids.at[k] + CHECKED_IDS, side="right")) - 1)
                some = [ids.flat[a:b].tolist() for a, b in zip(ids.at[k:upto], ids.at[k + 1 : upto + 1])]
                if out[k:upto] != [x.encode() for x in self.model.decode(some, num_threads=1)]:
                    raise ValueError("the decoded texts are not those of the library")
                k = upto
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """The text of ids whose bytes are no UTF-8 everywhere: each byte outside a character becomes U+FFFD."""
        out, held = [], b""

        def bytes_of(run: bytes):
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        run[:size].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(run[:size])
                    run = run[size:]
                    break
                else:
                    out.append("�".encode())
                    run = run[1:]

        for i in ids.tolist():
            piece = self.spelled.flat[self.spelled.at[i] : self.spelled.at[i + 1]].tobytes()
            if self.is_byte[i]:
                held += piece
            elif piece:
                bytes_of(held)
                held = b""
                out.append(piece)
        bytes_of(held)
        return b"".join(out)


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(model: str, check: bool = True) -> Codec:
    """This process's codec for a file of public_tokenizers or a path."""
    import public_tokenizers

    path = model if os.path.sep in model else public_tokenizers.path(model)
    if (path, check) not in _codecs:
        _codecs[path, check] = Codec(path, check)
    return _codecs[path, check]


def encode_and_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", check: bool = True, packed: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of every row of docs: its ids between the begin and end ids, and the text that they decode to.

    packed gives the ids as bytes: little-endian unsigned 32-bit integers one after the other.
    """

    def run(batches):
        for batch in pieces(batches, BYTES):
            own = codec(model, check)
            ids = own.framed(own.encode(*buffers(batch.column("text"))))
            if packed:
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids.at) - 1, [None, pa.py_buffer(4 * ids.at.astype(np.int64)), pa.py_buffer(ids.flat.astype("<i4"))]).cast(pa.binary())
            else:
                column = pa.ListArray.from_arrays(pa.array(ids.at.astype(np.int32)), pa.array(ids.flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(own.decode(ids), pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids {'binary' if packed else 'array<int>'}, decoded string")


def _digests(ids: pa.Array) -> pa.Array:
    flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
    return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1] - at[0], at[1:] - at[0])], pa.string())


def digest_of_ids(ids: Column) -> Column:
    """Lowercase hex SHA-256 of each row's ids as little-endian unsigned 32-bit integers."""
    return F.arrow_udf(_digests, StringType())(ids)
