"""Periodic runs, agenda encoding and importance resampling against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
from echoframe.llm import importance, periodic_runs, piece_codec
from echoframe.llm.pieces import Ragged
from echoframe.llm.text import buffers

from .conftest import SF, lower, text_of
from .test_kernels import MIXED

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(small, edges):
    return small.unionByName(edges.select(small.columns)).cache()


# 11
@pytest.fixture(scope="module")
def own():
    return piece_codec.Codec(MODEL)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def coded(own, texts):
    ids = own.encode(*buffers(pa.array(texts, pa.large_string())))
    return [ids.flat[a:b].tolist() for a, b in zip(ids.at[:-1], ids.at[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" ▁\tabcet'é日😀\n", max_size=60)), min_size=1, max_size=6))
def test_agenda_gives_the_ids_of_the_library(own, library, texts):
    assert coded(own, texts) == library.encode(texts)


def test_agenda_on_mixed_and_long_texts(own, library):
    texts = [*MIXED, "", None, "a" * 5000, "日本語テキスト" * 500, "the quick brown fox " * 3000, "x\u0000y", "ab" * 31, "ab" * 32, "ab" * 33, "<s> </s><unk> <0x41>", "▁▁a▁", "é ﬁ ① ½", "  " * 40 + "z"]
    assert coded(own, texts) == library.encode([t or "" for t in texts])


def test_agenda_takes_the_leftmost_of_equal_pairs(own, library):
    for text in ("aaaaaaa", "ababababa", "....…….", "        x", "hahahahahaha"):
        assert coded(own, [text]) == [library.encode(text)]


def test_a_wrong_merge_is_noticed(own):
    broken = piece_codec.Codec(MODEL)
    broken.table.merged = np.full_like(own.table.merged, own.table.number["▁"])
    with pytest.raises(ValueError, match="library"):
        broken.encode(*buffers(pa.array(["words that nobody has seen: qwertzuiop"], pa.large_string())))


def test_the_library_checks_in_parts(own, library, monkeypatch):
    """However many chunks are new, the library has few at once; and the last part is checked, too."""
    monkeypatch.setattr(piece_codec, "CHECKED", 50, raising=False)
    monkeypatch.setattr(piece_codec, "CHECKED_IDS", 200, raising=False)
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    most, texts = [], [f"{word(k)} of {word(7919 * k)}" for k in range(300)]
    fresh = piece_codec.Codec(MODEL)

    class Recorder:
        def encode(self, text):
            most.append(text.count(fresh.wall))
            return library.encode(text)

        def decode(self, rows, **options):
            assert len(rows) == 1 or sum(map(len, rows)) <= 200
            return library.decode(rows, **options)

    fresh.model = Recorder()
    ids = fresh.encode(*buffers(pa.array(texts, pa.large_string())))
    assert [ids.flat[a:b].tolist() for a, b in zip(ids.at[:-1], ids.at[1:])] == library.encode(texts)
    assert len(most) > 3 and max(most) <= 50
    assert [x.decode() for x in fresh.decode(ids)] == texts
    chunks = [f" {word(k)}".encode() for k in range(120)]
    right = fresh._ids(chunks)
    wrong = Ragged(np.append(right.flat[:-1], right.flat[-1] + 1).astype(np.int32), right.at)
    fresh._checked(chunks, right)
    with pytest.raises(ValueError, match="library"):
        fresh._checked(chunks, wrong)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 31999) | st.integers(0, 400), max_size=30), min_size=1, max_size=4))
def test_decoding_any_ids(own, library, rows):
    flat = np.array([i for r in rows for i in r], dtype=np.int32)
    ids = Ragged(flat, np.append(0, np.cumsum([len(r) for r in rows])))
    assert own.decode(ids) == [x.encode() for x in library.decode(rows)]


def test_piece_codec_over_a_table(spark, docs, empty, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.i, r.decoded) for r in piece_codec.encode_and_decode(docs).select("doc_id", F.size("ids").alias("n_tokens"), piece_codec.digest_of_ids(F.col("ids")).alias("i"), "decoded").collect())
    want = []
    for i, t in text_of(docs):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or -1, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), library.decode(ids)))
    assert got == sorted(want)
    assert piece_codec.encode_and_decode(empty).count() == 0


def test_packed_ids_are_the_bytes_of_the_ids(docs, empty):
    plain = sorted((r.doc_id or -1, struct.pack(f"<{len(r.ids)}I", *r.ids), r.decoded) for r in piece_codec.encode_and_decode(docs).collect())
    assert sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in piece_codec.encode_and_decode(docs, packed=True).collect()) == plain
    assert piece_codec.encode_and_decode(empty, packed=True).count() == 0


def test_piece_codec_query(spark, library):
    rows = {r.doc_id: r for r in entry.queries()["op11_piece_codec"](spark, SF).collect()}
    for i, t in text_of(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids)))


# 12
def counted(text, run=3, buckets=10_000):
    w = ALNUM.findall(lower(text))
    grams = [" ".join(w[k : k + n]) for n in range(1, run + 1) for k in range(len(w) - n + 1)]
    return Counter(zlib.crc32(g.encode()) % buckets for g in grams), len(w)


def resampled(docs, target, percent=5):
    """The contract, row by row."""
    s, t = Counter(), Counter()
    for _, text in target:
        t.update(counted(text)[0])
    rows = [(i, *counted(text)) for i, text in docs]
    for _, c, _ in rows:
        s.update(c)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, c, n in rows:
        weight = sum(k * gain[b] for b, k in c.items())
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[2], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("percent", [5, 60])
def test_resampling(spark, docs, benchmark, empty, percent):
    got = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in importance.resample(docs.repartition(7), benchmark, percent=percent).collect()]
    want = resampled(text_of(docs), [(None, r.text) for r in benchmark.collect()], percent)
    assert plain(got) == plain(want)
    assert importance.resample(empty, benchmark).count() == 0


def test_resampling_without_a_target_and_with_one_document(spark, empty):
    one = spark.createDataFrame([(7, "just one text of a few words " * 5)], "doc_id bigint, text string")
    [r] = importance.resample(one, empty, percent=100).collect()
    assert (r.doc_id, r.n_features, r.weight, r.score, r.rank) == (*resampled([(7, one.first().text)], [], 100)[0][:4], 1)


def test_equal_rows_are_ranked_one_by_one(spark, benchmark):
    rows = [(1, "the same words " * 10)] * 300 + [(k, f"other words {k} " * 10) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = importance.resample(docs, benchmark, percent=90).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 90 * 338 // 100 + 1)) and len(got) == 338


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab AB1é ", max_size=80)), min_size=1, max_size=6), st.integers(1, 4))
def test_blocks_hold_all_counts(texts, run):
    block, n_words = importance.Block.of(*buffers(pa.array(texts, pa.large_string())), 97, run)
    block = importance.Block.read(*block.bytes())
    for k, t in enumerate(texts):
        want, n = counted(t, run, 97)
        a, b = block.pointers[k], block.pointers[k + 1]
        assert dict(zip(block.columns[a:b].tolist(), block.counts[a:b].tolist())) == want and n_words[k] == n


def test_long_words_are_hashed_whole():
    words = ["y" * 63, "y" * 64, "y" * 65, "x" * 100_000, "z"]
    _, crc, _ = importance.features(*buffers(pa.array([" ".join(words)], pa.large_string())))
    assert sorted(crc.tolist()) == sorted(zlib.crc32(" ".join(words[k : k + n]).encode()) for n in (1, 2, 3) for k in range(6 - n))


# 13
def runs_of(w, shortest=12):
    """All periods, all stretches, as the definition says."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        k = 0
        while k + p < len(w):
            if w[k] != w[k + p]:
                k += 1
                continue
            a = k
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k + p - a >= max(shortest, 2 * p):
                found.setdefault((a, k + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def check_runs(w, shortest=12):
    assert periodic_runs.find_runs(np.array(w, dtype=np.int32), shortest) == runs_of(w, shortest)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6), st.sampled_from([2, 5, 12]))
def test_runs_of_repeated_stretches(parts, shortest):
    check_runs([x for part, times in parts for x in part * times], shortest)


def test_runs_of_known_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 700:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    nested = (("a" * 30 + "b") * 8 + "c") * 3
    rng = np.random.default_rng(5)
    phrase = rng.integers(0, 40, 70).tolist()
    noise = rng.integers(0, 40, 300).tolist()
    for w in ([], [1], [1] * 11, [1] * 12, [1, 2] * 6, [1, 2] * 5 + [1], [ord(c) for c in fibonacci[-1]], [ord(c) for c in nested], noise + phrase * 3 + noise, phrase * 2, phrase * 2 + [99] + phrase * 2, phrase[:5] * 40 + phrase * 4 + phrase[5:] + [7] * 50):
        check_runs(w)


def test_grid_in_many_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PROBES", 64)
    monkeypatch.setattr(periodic_runs, "REACH", 3)
    rng = np.random.default_rng(6)
    for _ in range(40):
        w = []
        while len(w) < 300:
            w += rng.integers(0, 3, rng.integers(1, 40)).tolist() * int(rng.integers(1, 5))
        check_runs(w)


def test_runs_of_one_word_and_of_long_periods():
    assert periodic_runs.find_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    long = np.random.default_rng(7).integers(0, 5, 60_000).astype(np.int32)
    assert (1000, 120_000, 60_000) in periodic_runs.find_runs(np.concatenate([np.full(1000, 9, np.int32), long, long]))


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_collapsing_over_a_table(spark, docs, empty):
    got = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse_runs(docs).collect())
    want = []
    for i, t in text_of(docs):
        w = WORD.findall(t or "")
        runs = runs_of(w) if len(w) < 5000 else [(0, 60_000, 1)]
        want.append((i or -1, runs, collapsed(w, runs)))
    assert got == sorted(want)
    assert periodic_runs.collapse_runs(empty).count() == 0


def test_planted_runs(spark, docs):
    got = sorted((r.doc_id or -1, WORD.findall(r.text or "")) for r in periodic_runs.with_planted_runs(docs).collect())
    assert got == sorted((i or -1, planted(i, t)) for i, t in text_of(docs))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in text_of(docs))


def test_runs_query(spark):
    rows = {r.doc_id: r for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()}
    texts = text_of(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(rows) == len(texts)
    for i, t in texts:
        w = planted(i, t)
        if len(w) > 3000:
            continue
        runs, r = runs_of(w), rows[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)) and r.collapsed_sha256 == sha(collapsed(w, runs))


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_periodic_runs"])
def test_sql_twins(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
