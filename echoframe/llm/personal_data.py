"""Personal data with offset-preserving deobfuscation.

Base detectors (e-mail, IPv4, payment card, phone) run on the text itself.  Beside
them, transducers rewrite a text step by step - look-alike characters, bracketed or
spelled at/dot, spelled digits - and keep for every character the source characters
that it stands for; the same detectors run on the rewritten text, and what they find
through a rewritten character maps back to source spans.  Base spans always stay;
a span that would overlap a base span of its kind isn't added.

Array operations over whole buffers leave out the texts in which neither a base
detector nor a transducer can find anything; that filter lets through every text that
a transducer would rewrite into a span.  Offsets are code points, ends exclusive.

Defined results: a null text is an empty one, without spans; an empty table gives an
empty result; very long texts are read whole; repeated rows give repeated results;
doc_id may be of any type, and further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces
from .text import ALNUM, buffers, hash_words, words

KINDS = ("email", "ip", "card", "phone")

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмтвнАВЕКМНОРСТУХІЈЅαονρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwkmtbhABEKMHOPCTYXIJSaovptukABEZHIKMNOPTYX"))
# Dashes and blanks that stand for the plain ones.
LOOKALIKES |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-") | dict.fromkeys("\u00a0\u2007\u2009\u202f", " ")
# Digits as words in four languages.
DIGIT_WORDS = {
    w: str(d)
    for language in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(language.split())
} | {"oh": "0"}
# Last labels that make an address of bare words.
TLDS = frozenset("com org net edu gov mil info biz io co uk us de fr es it nl eu ch at be ca au jp cn ru br in mx ar dev app ai me tv".split())
DOT_WORDS = "dot|punkt|punto|point"
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A later start in the same digits fails as the first one does, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base detectors' spans, by kind, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


class Tape:
    """A rewritten text that knows, for each of its characters, the source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.rewritten = text, False

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replace [a, b) by characters, each standing for [from, to) of this text; edits are in order and apart."""
        if not self.rewritten:  # most texts never are
            n, self.rewritten = len(self.text), True
            self.start, self.end, self.new = array("i", range(n)), array("i", range(1, n + 1)), bytearray(n)
        text, start, end, new, done = [], array("i"), array("i"), bytearray(), 0
        gaps = []
        for a, b, characters in [*edits, (len(self.text), len(self.text), [])]:
            text.append(self.text[done:a])
            start += self.start[done:a]
            end += self.end[done:a]
            new += self.new[done:a]
            for c, x, y in characters:
                text.append(c)
                start.append(self.start[x])
                end.append(self.end[y - 1])
                new.append(True)
            if a < b and not characters:
                gaps.append(len(new))
            done = b
        for k in gaps:  # what follows a vanished character counts as rewritten
            if k < len(new):
                new[k] = True
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


@lru_cache(maxsize=1 << 16)
def _stands_for(c: str) -> str | None:
    """The ASCII character that a character stands for; nothing for a hidden one, None for any other."""
    if c < "\u0080":
        return None
    if c in _HIDDEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain != c and len(plain) == 1 and plain.isascii() else None


def fold_lookalikes(tape: Tape) -> None:
    """Look-alike, full-width and styled letters and digits to ASCII; hidden characters vanish."""
    if tape.text.isascii():
        return
    plain = {c: p for c in set(tape.text) if (p := _stands_for(c)) is not None}
    if plain:
        tape.rewrite([(k, k + 1, [(plain[c], k, k + 1)] if plain[c] else []) for k, c in enumerate(tape.text) if c in plain])


_WORD_DIGITS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,-]+|\+\s*)?(?:(?:{_WORD_DIGITS}|[0-9]+)(?:[\s,-]+|(?!\w))|(?:{DOT_WORDS})\s+(?=(?:{_WORD_DIGITS})(?!\w))){{3,}}", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"plus|\+|{_WORD_DIGITS}|[0-9]+|{DOT_WORDS}", re.IGNORECASE)
#: Blanks before a bracket are tried from the first one only, so that long runs of them cost linear time.
_DOT = re.compile(rf"(?:(?<!\s)\s+)?[(\[{{<]\s*(?:{DOT_WORDS}|\.)\s*[)\]}}>]\s*|(?<=[A-Za-z0-9])\s+(?:{DOT_WORDS}|\.)\s+(?=[A-Za-z0-9])", re.IGNORECASE)
_AT_BRACKETS = re.compile(r"(?:(?<!\s)\s+)?[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]\s*", re.IGNORECASE)
_AT_APART = re.compile(r"(?<=[A-Za-z0-9])(?:\s+@\s*|@\s+)(?=[A-Za-z0-9])")
#: An address of figures with spelled dots; letters one by one before an @.
_IP_WORDS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\s+(?:{DOT_WORDS})\s+|\.)[0-9]{{1,3}}){{3}}(?![\w.])", re.IGNORECASE)
_LETTERS = re.compile(r"(?<!\S)(?:[A-Za-z0-9]\s){2,}[A-Za-z0-9](?=\s*@)")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
#: What makes "name at host.tld" an address: a name that is no plain word, or one of these words before it (fixed values).
_NAME = re.compile(r"[A-Za-z0-9._%+-]+$")
_CUE = re.compile(r"(?<!\w)(?:e-?mails?|mail(?:to)?|contact|write|reach|address|correo|courriel|adresse?|kontakt)(?!\w)", re.IGNORECASE)
_AT_WORD = re.compile(r"(?<=[A-Za-z0-9])\s+(?:at|arroba)\s+(?=[A-Za-z0-9])", re.IGNORECASE)


def read_spelled_digits(tape: Tape) -> None:
    """Three or more numbers in a row of which some are spelled, with spelled dots and plus: to figures."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        parts = [(p[0].lower(), *p.span()) for p in _SPELLED_PART.finditer(tape.text, *m.span())]
        figures = []
        for p, a, b in parts:
            if p.isdigit():
                figures += [(c, a + k, a + k + 1) for k, c in enumerate(p)]
            else:
                figures.append(("+" if p in ("plus", "+") else DIGIT_WORDS.get(p, "."), a, b))
        if any(p in DIGIT_WORDS for p, _, _ in parts):
            edits.append((parts[0][1], parts[-1][2], figures))
    if edits:
        tape.rewrite(edits)


def join_letters(tape: Tape) -> None:
    """Single letters with blanks between them before an @: to one word."""
    if "@" not in tape.text:
        return
    edits = []
    for m in _LETTERS.finditer(tape.text):
        edits += [(k, k + 2, [(tape.text[k], k, k + 1)]) for k in range(m.start(), m.end() - 1, 2)]
    if edits:
        tape.rewrite(edits)


def read_at_and_dot(tape: Tape) -> None:
    """Bracketed at and dot; blanks around an @; bare words where both occur in one address (name at host dot com), where the host has its dots and what stands before tells an address, and in addresses of figures."""
    figures = [m.span() for m in _IP_WORDS.finditer(tape.text)]
    opened, closed = [a for a, _ in figures], [b for _, b in figures]

    def inside(a: int) -> bool:
        k = bisect_left(opened, a) - 1
        return k >= 0 and a < closed[k]

    dots = [(m.start(), m.end(), ".", m[0].strip()[:1] in "([{<" or inside(m.start())) for m in _DOT.finditer(tape.text)]
    ats = [(m.start(), m.end(), "@", True) for m in _AT_BRACKETS.finditer(tape.text)]
    bare = [(m.start(), m.end(), "@", False) for p in (_AT_WORD, _AT_APART) for m in p.finditer(tape.text)]
    ends = {a for a, _, _, _ in dots}

    def host_follows(a: int, b: int) -> bool:
        m = _HOST.match(tape.text, b)
        if not m or m.end() in ends:
            return bool(m)
        if "." not in m[0]:
            return False
        if "@" in tape.text[a:b]:
            return True
        name = _NAME.search(tape.text, max(0, a - 64), a)
        told = name and (re.search("[0-9._%+]", name[0]) or _CUE.search(tape.text, max(0, name.start() - 24), name.start()))
        return bool(told) and m[0].rsplit(".", 1)[1].lower() in TLDS

    ats += [x for x in bare if host_follows(x[0], x[1])]
    signs = sorted({b for _, b, _, _ in ats})
    edits, busy = [], -1
    for a, b, sign, sure in sorted([*dots, *ats]):
        before, after = bisect_right(signs, a), bisect_left(signs, b)
        near = before and a - signs[before - 1] < 80 or after < len(signs) and signs[after] - b < 80 or "@" in tape.text[max(0, a - 80) : a]
        if a >= busy and (sign == "@" or sure or near):
            edits.append((a, b, [(sign, a, b)]))
            busy = b
    if edits:
        tape.rewrite(edits)


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Source spans that show only through rewritten characters and overlap no base span of their kind."""
    tape = Tape(text)
    fold_lookalikes(tape)
    read_spelled_digits(tape)
    join_letters(tape)
    read_at_and_dot(tape)
    if not tape.rewritten:
        return []
    # spans of a kind are in order and apart
    known = {kind: ([a for k, a, _ in base if k == kind], [b for k, _, b in base if k == kind]) for kind in KINDS}
    out = []
    for kind, a, b in base_spans(tape.text):
        if any(tape.new[a:b]):
            x, y = tape.start[a], tape.end[b - 1]
            if kind == "email" and not re.search(r"[@(\[{<]", text[x:y]) and tape.text[a:b].rsplit(".", 1)[1].lower() not in TLDS:
                continue  # bare words; "look at the dot on it" is no address
            starts, ends = known[kind]
            last = bisect_left(starts, y) - 1
            if last < 0 or ends[last] <= x:
                out.append((kind, x, y))
    return out


def find_personal_data(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text."""
    base = base_spans(text)
    return base, disguised_spans(text, base)


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _hashes(texts: list[str]) -> np.ndarray:
    return np.sort(np.concatenate(hash_words(texts, ALNUM)))


#: Words fold A-Z only, the transducers' patterns any letter.
_DIGIT_HASHES = _hashes([*DIGIT_WORDS, *(w.upper() for w in DIGIT_WORDS if not w.isascii())])
_DOT_HASHES = _hashes(DOT_WORDS.split("|"))
_AT_HASHES = _hashes(["at", "arroba"])
_FIGURE = np.zeros(256, dtype=bool)
_FIGURE[range(0x30, 0x3A)] = True
_PLAIN = _FIGURE.copy()
_PLAIN[0x40] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BRACKET = np.zeros(256, dtype=bool)
_BRACKET[list(b"([{<")] = True


def _any_by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] > total[bounds[:-1]]


def _strange(data: np.ndarray) -> np.ndarray:
    """Bytes of characters other than ASCII and the letters from U+00C0 to U+00FF; only such characters are folded, and only they part words in ways that ALNUM doesn't know."""
    out = data >= 0x80
    if len(data) > 1:
        lead, rest = data[:-1], data[1:]
        letter = np.flatnonzero((lead == 0xC3) & (rest != 0x97) & (rest != 0xB7))
        out[letter] = out[letter + 1] = False
    return out


def _dotted_hosts(data: np.ndarray, w, at_word: np.ndarray, dot: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Texts with an at as a word and a dot before a letter in what follows up to the next blank."""
    out = np.zeros(len(w.first) - 1, dtype=bool)
    spots = np.flatnonzero(at_word[:-1])
    if len(spots):
        edges = np.append(np.flatnonzero(blank), len(data))
        begin = w.start[spots + 1]
        end = edges[np.searchsorted(edges, begin)]
        total = np.concatenate([[0], np.cumsum(dot & np.append(_LETTER[data[1:]], False))])
        found = spots[total[end] > total[begin]]
        out[np.searchsorted(w.first, found, side="right") - 1] = True
    return out


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that may hold base spans, and texts that may hold disguised ones.

    Without a strange character, a text is rewritten only if it has three digit words,
    dot words or numbers of any length in a row with a digit or dot word among them; a bracket
    with an at or dot behind it; an @ beside a blank; a dot word or a dot between
    blanks together with an at or @; or an at before a word with a dot before a letter in it.
    """
    w = words(data, offsets, ALNUM)
    in_texts = lambda flags: _any_by_text(flags, offsets)
    member = lambda keys: keys[np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)] == w.hash
    figures = np.concatenate([[0], np.cumsum(_FIGURE[data])])
    spelled, dot_word = member(_DIGIT_HASHES), member(_DOT_HASHES)
    part = spelled | dot_word | (figures[w.end] - figures[w.start] == w.end - w.start)
    run = np.zeros(len(part), dtype=bool)
    if len(part) > 2:
        read = spelled | dot_word
        run[:-2] = part[:-2] & part[1:-1] & part[2:] & (read[:-2] | read[1:-1] | read[2:])
    blank = data <= 0x20
    before, after = np.append(True, blank[:-1])[: len(data)], np.append(blank[1:], True)[: len(data)]
    behind = np.append(False, _BRACKET[data[:-1]])[: len(data)]
    sign, dot = data == 0x40, data == 0x2E
    at = in_texts(sign) | _any_by_text(member(_AT_HASHES), w.first)
    dots = _any_by_text(dot_word, w.first)
    disguised = in_texts(_strange(data)) | _any_by_text(run, w.first) | in_texts(sign & (before | after))
    disguised |= in_texts(_BRACKET[data]) & (at | dots | in_texts(dot & (before | behind)))
    disguised |= at & (dots | in_texts(dot & before & after))
    return in_texts(_PLAIN[data]), disguised | _dotted_hosts(data, w, member(_AT_HASHES), dot, blank)


def find_all(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs; the counts are of base spans."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in pieces(batches):
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), dtype=np.int64)
            added = np.zeros(n, dtype=np.int64)
            digests, spans = [empty] * n, [""] * n
            plain, odd = suspects(*buffers(batch.column("text")))
            for d in np.flatnonzero(plain | odd):
                text = batch.column("text")[int(d)].as_py()
                base = base_spans(text) if plain[d] else []
                more = disguised_spans(text, base) if odd[d] else []
                for kind, _, _ in base:
                    counts[KINDS.index(kind), d] += 1
                added[d] = len(more)
                if base:
                    digests[d] = hashlib.sha256(join_spans(base).encode()).hexdigest()
                if base or more:
                    spans[d] = join_spans(base + more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans), pa.array(added)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
