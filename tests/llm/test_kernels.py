"""Text kernels against plain Python."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from echoframe.llm import fingerprints, near_duplicates, personal_data, statistics
from echoframe.llm.pieces import Encoder, Ragged, text_buffers
from echoframe.llm.text import ALNUM, buffers, shingles, words
from echoframe.llm.token_counts import Counter as TokenCounter

from .conftest import EDGES, lower

TEXTS = [t for _, t, *_ in EDGES]
PARTS = ["a", "Z", "é", "7", " ", "  ", "\n", "\t", "'", "'s", "'ll", "the", "ing", "!", "<|endoftext|>", "<s>", "日本", " ", "×", "ß", "▁", "\r\n", "½", "\x1c", "don't", "𝒳", "\x00"]


def mixtures(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("member,pattern", [(None, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(member, pattern):
    texts = TEXTS + mixtures(500)
    data, offsets = buffers(pa.array(texts))
    w = words(data, offsets, *([] if member is None else [member]))
    seen = {}
    for d, t in enumerate(texts):
        found = re.findall(pattern, lower(t))
        assert w.first[d + 1] - w.first[d] == len(found)
        for k, f in enumerate(found):
            assert seen.setdefault(f, w.hash[w.first[d] + k]) == w.hash[w.first[d] + k]
    assert len(set(seen.values())) == len(seen)


def test_words_over_window_cuts():
    text = "ab " * 200_000 + "y" * 600_000 + " z"
    w = words(*buffers(pa.array([text, None, "ab z"])))
    assert len(w.hash) == 200_004 and len(set(w.hash.tolist())) == 3


def test_shingles():
    w = words(*buffers(pa.array(["a b c d e", "a b c", "c b a", "", None, "a b c"])))
    h, at = shingles(w, 4)
    assert np.diff(at).tolist() == [2, 1, 1, 0, 0, 1]
    assert h[at[1]] == h[at[5]] != h[at[2]]


def test_encoder_equals_library():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = mixtures(4000) + [t or "" for t in TEXTS]
    got = e.encode(*text_buffers(texts))
    for k, x in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got.flat[got.at[k] : got.at[k + 1]].tolist() == x.ids


def test_token_counts_equal_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = mixtures(4000) + [t or "" for t in TEXTS] + ["".join(random.Random(k).choices("abcdeéß日th", k=500)) for k in range(10)]
    got = TokenCounter(path).count(*text_buffers(texts))
    assert got.tolist() == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]


def test_ragged():
    r = Ragged(np.arange(6), np.array([0, 2, 2, 6]))
    assert r.take(np.array([2, 0, 1])).tolist() == [2, 3, 4, 5, 0, 1]


def test_registers_and_bands():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 5, 300, 5000)]
    regs = near_duplicates.registers(sets)
    assert not regs[0].any() and (regs[1:] > 0).all()
    hits = []
    for _ in range(60):
        both = rng.integers(0, 2**63, 800).astype(np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**63, 100).astype(np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**63, 100).astype(np.uint64)]))
        r = near_duplicates.registers([a, b])
        hits.append(near_duplicates.estimate((r[0] == r[1]).sum()))
        assert (near_duplicates.band_keys(r[:1]) == near_duplicates.band_keys(r[1:])).any()
    assert abs(np.mean(hits) - 0.8) < 0.02


def test_blocks_find_all_links():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, rng.integers(20, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets[:40]]
    comp = rng.permutation(len(sets)).astype(np.int64)
    comp[5] = comp[9]
    regs = near_duplicates.registers(sets)

    def tiles(rows):
        return [near_duplicates.Tile(comp[rows[k : k + 70]], regs[rows[k : k + 70]], [sets[i].tobytes() for i in rows[k : k + 70]]) for k in range(0, len(rows), 70)]

    def slow(pairs):
        parent = {int(c): int(c) for c in comp}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in pairs:
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(int(comp[i])), find(int(comp[j]))))
                parent[b] = a
        return {c: find(c) for c in parent if find(c) != c}

    every, half = np.arange(len(sets)), len(sets) // 2
    got = near_duplicates.one_component(tiles(every), None, 80)
    want = slow([(i, j) for i in every for j in every[:i]])
    assert len(want) > 40 and dict(zip(*(x.tolist() for x in got))) == want
    got = near_duplicates.one_component(tiles(every[:half]), tiles(every[half:]), 80)
    assert dict(zip(*(x.tolist() for x in got))) == slow([(i, j) for i in every[:half] for j in every[half:]])


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and personal_data.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans():
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choices(["a", "b.", "@", "1", "22", "255", ".", "-", " ", "+", "(", "@x.y", "4111111111111111", "é", "_"], k=rng.randint(0, 16)))
        assert personal_data.base_spans(t) == base(t)


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"), ("say john dot smith at example dot org please", "email", "say john dot smith at example dot org"[4:]),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("call plus four nine one seven zero five five five one two three", "phone", "plus four nine one seven zero five five five one two three"),
        ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"), ("x vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins x", "card", None),
        ("a​b@x​.com", "email", "a​b@x​.com"), ("write john @ mail . com today", "email", "john @ mail . com"), ("write john @ mail.com today", "email", "john @ mail.com"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"), ("host 192 punkt 168.0 DOT 1, up", "ip", "192 punkt 168.0 DOT 1"), ("write john @example.com today", "email", "john @example.com"), ("mail john at example.com today", "email", "john at example.com"),
        ("see john.smith at example.org", "email", "john.smith at example.org"), ("to j o h n @ example.com now", "email", "j o h n @ example.com"), ("to j o h n@example . com now", "email", "j o h n@example . com"),
        ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"), ("card 4111\u20131111\u20131111\u20131111 ok", "card", "4111\u20131111\u20131111\u20131111"), ("tel +٤٩ ١٧٠ ٥٥٥١٢٣", "phone", "+٤٩ ١٧٠ ٥٥٥١٢٣"),
    ],
)
def test_disguises(text, kind, part):
    plain, added = personal_data.find_personal_data(text)
    assert [k for k, _, _ in added] == [kind]
    assert part is None or text[added[0][1] : added[0][2]] == part
    assert personal_data.suspects(*buffers(pa.array([text])))[1][0]


MIXED = [
    "call +1 202 555 five zero 12 now", "+49 170 555 null eins 23", "card 4111 1111 1111 one one 11", "john@example . com", "john at example . com", "john ( @ ) example ( . ) com",
    "host 192 ( . ) 168 ( . ) 0 ( . ) 1 up", "tel +49 170 FÜNF 555 ZÉRO 123", "tel +49\x85170\x85fünf\x85555\x85123", "card 4111 ×four×1 1 1111 1111 1111", "tel +៤៩ ១៧០ ៥៥៥១២៣", "jᵒhn@exam​ple.com", "mail john at example.com", "j o h n @ example.com", "10 dot 0 dot 0 dot 7", "a.b at x.com", "jᴼhn＠example.com", "write\u3000john\u3000@ mail.com",
]


def test_long_texts_full_of_disguises():
    """Every unit of a long text gives the spans that it gives alone, in time in proportion to the text."""
    units = [
        "write to ann{k} (at) example (dot) com and bob{k}@host.org now. ", "server 10 dot {k} dot 3 dot 4 or 10.1.2.{k} up. ", "call plus one two oh two five five five zero one 7 nine eight. ", "john{k} @ example . com or mary at mail.example.com ",
        "card 4111 1111 1111 1111 and \uff14111 1111 1111 1111; ",
    ]
    seconds = []
    for times in (400, 3200):
        text, base, added = "", [], []
        for k in range(times):
            unit = units[k % len(units)].format(k=k % 250) + "\n" * 90
            known, more = personal_data.find_personal_data(unit)
            base += [(kind, a + len(text), b + len(text)) for kind, a, b in known]
            added += [(kind, a + len(text), b + len(text)) for kind, a, b in more]
            text += unit
        began = time.process_time()
        got = personal_data.find_personal_data(text)
        seconds.append(time.process_time() - began)
        assert sorted(got[0]) == sorted(base) and sorted(got[1]) == sorted(added) and len(added) >= times // 2
    assert seconds[1] < 24 * seconds[0] + 0.5


@pytest.mark.parametrize("text", MIXED)
def test_mixed_disguises_pass_the_filter(text):
    plain, disguised = personal_data.suspects(*buffers(pa.array([text])))
    base, added = personal_data.find_personal_data(text)
    assert (plain[0] or not base) and (disguised[0] or not added)


def test_the_filter_lets_through_whatever_is_rewritten():
    rng = random.Random(8)
    parts = [*personal_data.DIGIT_WORDS, "FÜNF", "Zéro", *"0123456789", "12", "4111", " ", " ", " ", " ", "-", ", ", "+", "plus ", ".", " . ", "@", " @ ", " at ", "arroba", " dot ", "punkt", "(", "[", ")", "]", "< ", "ab", "x.com", "mail ", "a.b", "10", "é", "×", "_", "\x1c", "\x85", "ｊ", "ᵒ", "٤", "¹", "。", "“"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(30000)] + MIXED + [None, ""]
    plain, disguised = personal_data.suspects(*buffers(pa.array(texts, pa.large_string())))
    found = 0
    for text, p, d in zip(texts, plain, disguised):
        base, added = personal_data.find_personal_data(text or "")
        found += len(added)
        assert (p or not base) and (d or not added), text
        if not d:
            tape = personal_data.Tape(text or "")
            for step in (personal_data.fold_lookalikes, personal_data.read_spelled_digits, personal_data.join_letters, personal_data.read_at_and_dot):
                step(tape)
            assert not getattr(tape, "rewritten", any(getattr(tape, "new", ()))), text
    assert found > 100
    for c in range(0xC0, 0x100):  # letters that the filter takes as plain
        tape = personal_data.Tape(chr(c))
        personal_data.fold_lookalikes(tape)
        assert tape.text == chr(c)


def test_every_digit_and_lookalike_passes_the_filter():
    import sys
    import unicodedata

    zeros = [chr(c) for c in range(0x80, sys.maxunicode + 1) if chr(c).isdecimal() and unicodedata.decimal(chr(c)) == 0]
    texts = ["tel +" + "".join(chr(ord(z) + int(c)) for c in "491705551234") for z in zeros] + ["mail john@" + "example.com".replace(plain, c, 1) for c, plain in personal_data.LOOKALIKES.items() if plain in "exampl"]
    assert len(texts) > 70
    plain, disguised = personal_data.suspects(*buffers(pa.array(texts)))
    for text, d in zip(texts, disguised):
        assert d and len(personal_data.find_personal_data(text)[1]) == 1, text


def test_long_runs_of_blanks_and_dots_cost_linear_time():
    assert personal_data.find_personal_data("a" + " " * 300000 + "x [at] y" + " ." * 50000)[0] == []


def test_plain_text_is_left_alone():
    for text in ("we met at noon on the dot at the point of no return", "un deux trois", "look at example.com dot", "meet me at example.com", "1 dot 2 dot 3", "a (b) at [c]"):
        assert personal_data.find_personal_data(text) == ([], [])


def test_fingerprints():
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rng.randint(1, 40))) + (" %d" % k) for k in range(60))
    other = text.replace("alpha", "omega", 1)
    both = fingerprints.Forest(*buffers(pa.array([text, text, other, "", None, "x", " \n"])))
    f = both.fingerprints()
    assert f[0] == f[1] != f[2] and f[3] == f[4] and len(set(f)) == 5
    assert fingerprints.likeness_of(f[0], f[2]) > 0.95 and fingerprints.likeness_of(f[0], f[5]) == 0 and fingerprints.likeness_of(f[3], f[4]) == 1
    assert len(fingerprints.differing_branches(f[0], f[2])) == 1 and fingerprints.differing_branches(f[0], f[1]) == []
    got = fingerprints.likeness(both, both, np.array([0, 0, 3]), np.array([2, 5, 4]))
    assert got.tolist() == [fingerprints.likeness_of(f[a], f[b]) for a, b in ((0, 2), (0, 5), (3, 4))]
    leaves = sum(len(ls) for _, ps in fingerprints.parse(f[0])[1] for _, ls in ps)
    assert leaves == both.leaf_at[1]


def test_edits_are_located_from_the_roots_down():
    rng = random.Random(5)
    pick = lambda n: "".join(rng.choices(["alpha ", "béta ", "γ ", "delta\n", "\n", "x" * 30 + " ", "😀 "], k=n))
    pairs = [("", ""), ("", "x"), ("x", ""), ("a b", "a b"), ("same " * 50, "same " * 49), ("\n\n", "\n")]
    for _ in range(300):
        text = pick(rng.randint(0, 300))
        i, j = sorted(rng.randint(0, len(text)) for _ in range(2))
        pairs.append((text, text[:i] + pick(rng.randint(0, 20)) + text[min(j, i + 40) :]))
        pairs.append((text, pick(rng.randint(0, 300))))
    a, b = (fingerprints.Forest(*buffers(pa.array(list(x)))) for x in zip(*pairs))
    every = np.arange(len(pairs))
    narrow = 0
    for (x, y), e in zip(pairs, fingerprints.edits(a, b, every, every)):
        assert (e is None) == (x == y)
        if e is not None:
            start, end, new = e
            assert 0 <= start <= end <= len(x) and start <= new <= len(y)
            assert x[:start] + y[start:new] + x[end:] == y and (end > start or new > start)
            narrow += end - start < len(x) // 2
    assert narrow > 200


def slow_root(text):
    """The root of a text's tree by loops over its words, lines and children."""
    import re

    from echoframe.llm.pieces import hash_spans
    from echoframe.llm.text import hash_words, mix64

    fp = fingerprints
    raw = text.encode()
    ws = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    h = [int(hash_words([raw[a:b].decode()])[0][0]) for a, b in ws]
    salted = lambda v: int(mix64(np.array([v ^ int(fp._SALT)], dtype=np.uint64))[0])
    cuts = {0} | {k + 1 for k, c in enumerate(raw) if c == 10 and k + 1 < len(raw)}
    for k in range(1, len(ws)):
        if len(ws) < 2 * fp.PHRASE or salted(h[k - 1]) % fp.PHRASE == 0:
            cuts.add(ws[k][0])
    run, before = 0, 0
    for a, _ in ws:
        run = 0 if any(before < c <= a for c in cuts) else run
        if run and run % fp.LONGEST == 0:
            cuts.add(a)
        run, before = run + 1, a
    starts = sorted(cuts)
    leaf = [int(hash_spans(np.frombuffer(raw, np.uint8), np.array([s]), np.array([e]))[0]) for s, e in zip(starts, starts[1:] + [len(raw)])]

    def fold(children):
        total = sum(int(mix64(np.array([c], np.uint64) ^ mix64(np.array([k], np.uint64) + fp._SALT))[0]) for k, c in enumerate(children))
        return int(mix64(np.array([(total + len(children)) % 2**64], np.uint64))[0])

    paragraphs: list[list[int]] = []
    texts = []
    for s, v in zip(starts, leaf):
        if s == 0 or raw[s - 1] == 10:
            paragraphs.append([])
            texts.append(raw[s:].split(b"\n")[0])
        paragraphs[-1].append(v)
    sections: list[list[int]] = []
    fresh = True
    for k, p in enumerate(paragraphs):
        if fresh:
            sections.append([])
        sections[-1].append(fold(p))
        fresh = texts[k] == b"" or salted(fold(p)) % fp.SECTION == 0
    return fold([fold(s) for s in sections])


def test_roots_equal_slow_trees():
    rng = random.Random(9)
    texts = ["x", " \n", "one two\n\nthree", ] + [f"{w} " * 100 for w in "word term sign note page line".split()] + ["".join(rng.choices(["alpha ", "béta ", "γ ", "delta\n", "\n", "rare%d " % k], k=rng.randint(1, 90))) for k in range(40)]
    roots = fingerprints.Forest(*buffers(pa.array(texts))).root
    assert [slow_root(t) for t in texts] == roots.tolist()


def test_statistics_are_finite():
    x = statistics.document_statistics(*buffers(pa.array(TEXTS)))
    assert x.shape == (len(TEXTS), len(statistics.NAMES)) and np.isfinite(x).all()
    assert (x[4] == x[5]).all()


def test_discriminant_equals_densities():
    """Log densities of both classes by plain formulas: shrunken covariances, determinants and solved systems."""
    from echoframe.llm import quality

    rng = np.random.default_rng(7)
    w = quality.WIDTH
    y = rng.random(400) < 0.7
    x = rng.normal(size=(400, w)) @ rng.normal(size=(w, w)) / 3 + y[:, None] * rng.normal(size=w)
    sums = {k: np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)]) for k in (0, 1) if len(z := x[y == k])}
    got = quality.Discriminant(sums).scores(x[:50])
    cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    both = ((~y).sum() * cov[0] + y.sum() * cov[1]) / len(y)
    scale = np.sqrt(np.diag(both))
    for row, g in zip(x[:50], got):
        density = {}
        for k in (0, 1):
            c = (0.5 * cov[k] + 0.5 * both) / np.outer(scale, scale)
            c = 0.95 * c + 0.05 * np.eye(w) * np.trace(c) / w
            d = (row - x[y == k].mean(axis=0)) / scale
            density[k] = np.log((y == k).mean()) - 0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(c)[1]
        assert g == pytest.approx(1 / (1 + np.exp(density[0] - density[1])), abs=1e-6)


def test_label_model_equals_slow_loops():
    """Strengths from triplets of voters, evidence discounted by what remains between two of them."""
    from echoframe.llm import toxicity

    rng = np.random.default_rng(8)
    hidden = rng.random(5000) < 0.2
    votes = np.stack([rng.random(5000) < np.where(hidden, hit, miss) for hit, miss in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.5, 0.1), (0.1, 0.1))], axis=1).astype(float)
    votes[:, 3] = np.maximum(votes[:, 3], votes[:, 2])
    n = len(votes)
    model = toxicity.LabelModel(n, votes.sum(axis=0), votes.T @ votes, 0.2)
    r = np.corrcoef(votes.T)
    strength = []
    for i in range(5):
        friends = [j for j in sorted(range(5), key=lambda j: -r[i, j] if j != i else 0) if j != i and r[i, j] > 0.05]
        guesses = [r[i, j] * r[i, k] / r[j, k] for a, j in enumerate(friends) for k in friends[a + 1 :] if r[j, k] > 0.05]
        strength.append(min(np.sqrt(min(max(np.median(guesses), 0), 0.9)), 0.95) if len(guesses) >= 3 else 0.0)
    assert model.strength.tolist() == pytest.approx(strength)
    fired = []
    for i in range(5):
        extra = sum(max(rest, 0) for j in range(5) if j != i and abs(rest := r[i, j] - strength[i] * strength[j]) > 0.1)
        mean, sd = votes[:, i].mean(), votes[:, i].std()
        gap = strength[i] * sd / np.sqrt(0.2 * 0.8)
        clip = lambda p: min(max(p, 1e-4), 0.999)
        fired.append(np.log(clip(mean + 0.8 * gap) / clip(mean - 0.2 * gap)) / (1 + extra))
    assert model.fired.tolist() == pytest.approx(fired)
    assert ((model.posterior(votes) > 0.5) == hidden).mean() > 0.9
    # labels speak for the voters that triplets can't determine, and for no others
    known = np.linspace(0.1, 0.5, 5)
    helped = toxicity.LabelModel(n, votes.sum(axis=0), votes.T @ votes, 0.2, known)
    assert helped.strength.tolist() == pytest.approx([s or k for s, k in zip(strength, known)]) and strength[4] == 0 < strength[0]


def test_counter_is_exact():
    assert Counter(lower("Ab aB")) == Counter("ab ab")
