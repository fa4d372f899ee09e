"""Operators over DataFrames: edge rows, empty tables, brute force on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from echoframe.llm import decontaminate, fingerprints, language_model, mixing, near_duplicates, personal_data, quality, token_counts, token_files, toxicity, word_counts
from echoframe.llm.text import buffers

from .conftest import SF, lower, text_of
from .test_kernels import MIXED

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(small, edges):
    """The small table and the edge rows."""
    return small.unionByName(edges.select(small.columns)).cache()


# 1
def test_language_model(spark, docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in language_model.score_documents(docs).collect()}
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows, counts = text_of(docs), Counter()
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    model = base = 0.0
    for i, t in rows:
        w = tokens(t)
        r = got[i, len(w)]
        expected = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert r.held_out == held(i) and r.train_tokens == n and r.n_known == sum(counts[x] > 0 for x in w) and r.base_score == pytest.approx(expected)
        assert r.score < 0
        if held(i):
            model, base = model + r.score, base + r.base_score
    assert model > base
    assert language_model.score_documents(empty).count() == 0


def test_language_model_keeps_edge_rows(spark, edges):
    """Clashing columns, nulls, repeated rows, empty and very long texts."""
    got = language_model.score_documents(edges).collect()
    assert len(got) == edges.count() and sum(r.doc_id == 9003 for r in got) == 2 and len({(r.score, r.bits) for r in got if r.doc_id == 9003}) == 1
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (9000, 9001, 9002)) and all(math.isfinite(r.score) and r.bits >= 0 for r in got)


def test_language_model_is_a_distribution():
    frequency = np.ones(language_model.SYMBOLS, dtype=int)
    nodes, bits = language_model.huffman(frequency)
    assert sum(2.0 ** -n for n in np.diff(nodes.at)) == pytest.approx(1)


def test_language_model_knows_rare_words_by_the_words_before_them(spark, monkeypatch):
    monkeypatch.setattr(language_model, "GROUP_BYTES", 40_000)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 50_000)
    rng = np.random.default_rng(4)
    pairs = [(f"a{k}", f"b{k}") for k in range(1500)]  # each word is far from the most frequent ones, and as frequent as the others
    text = lambda ks, shift: " ".join(f"{pairs[k][0]} {pairs[(k + shift) % 1500][1]}" for k in ks)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    drawn = [rng.choice(1500, 40, replace=False) for _ in range(400)]
    rows = [(i, text(drawn[i], 0)) for i in range(400)] + [(i, text(drawn[i], 7)) for i in held]
    scored = language_model.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    bits = defaultdict(list)
    for r in scored:
        if r.held_out:
            bits[r.doc_id].append(r.bits)
    assert len(scored) == len(rows) and all(len(b) == 2 for b in bits.values())
    assert all(min(b) < 0.85 * max(b) for b in bits.values())


def test_language_model_counts_pairs_and_triples_of_words():
    texts, held = ["a b a b c", "", "b a b", "a b d"], np.array([False, False, False, True])
    docs = pa.table({"text": texts, "held": held})
    for fine in (1, 5):
        ranges = {k: word_counts.Ranges(b, fine) for k, b in ((word_counts.WORDS, 64), (word_counts.GRAMS, 40))}
        rows = word_counts.table(language_model._asks_of(3, docs, ranges, 40)).to_pylist()
        blocks = [word_counts.table([tuple(r.values()) for r in rows if (r["kind"], r["bucket"]) == b]) for b in {(r["kind"], r["bucket"]) for r in rows}]
        answers = pa.concat_tables([word_counts._adder(language_model._sums_of_words)(b) for b in blocks])
        tokens = language_model.Tokens(docs["text"])
        grams = language_model.Grams(tokens, 40)
        grams.index()
        word = word_counts.answered(answers, word_counts.WORDS, tokens.distinct, ranges[word_counts.WORDS])
        gram = word_counts.answered(answers, word_counts.GRAMS, grams.distinct, ranges[word_counts.GRAMS])
        got = grams.contexts(tokens, word, gram, 3, held)
        lines = [["^", *t.split(), "$"] for t in texts]
        count = Counter(tuple(w[k : k + n]) for w, h in zip(lines, held) if not h for n in (1, 2, 3) for k in range(len(w) - n + 1))
        k = 0
        for w, h in zip(lines, held):
            for at in range(1, len(w)):
                out = 0 if h else 1
                want = [(count[w[at - 1],] - out, count[tuple(w[at - 1 : at + 1])] - out), (0, 0) if at == 1 else (count[tuple(w[at - 2 : at])] - out, count[tuple(w[at - 2 : at + 1])] - out)]
                assert [(n[k], c[k]) for n, c in got] == want
                k += 1


@pytest.mark.parametrize("fan", [8, 4096])
def test_word_counts_through_teams_of_groups(spark, fan):
    """1,000 groups with at most 8 ranges of their own: more than one level of merging."""
    rng = np.random.default_rng(3)
    ranges = {k: word_counts.Ranges(b, 50, fan) for k, b in ((word_counts.WORDS, 64), (word_counts.GRAMS, 30))}
    rows, want, held = [], defaultdict(Counter), []
    for group in range(1000):
        for kind, bits in ((word_counts.WORDS, 64), (word_counts.GRAMS, 30)):
            keys = np.unique(rng.integers(0, 60, 12).astype(np.uint64) * np.uint64((1 << bits) // 61))
            counts = rng.integers(0, 3, len(keys))
            held.append((kind, group, keys))
            rows += word_counts.asks(kind, group, keys, counts, ranges[kind])
            for k, c in zip(keys.tolist(), counts.tolist()):
                want[kind][k] += c
    asked = spark.createDataFrame(word_counts.table(rows).to_pandas(), word_counts.COLUMNS)
    assert asked.groupBy("kind", "owner").count().agg(F.max("count")).first()[0] <= min(fan, 12)
    found = word_counts.totals(asked, ranges, language_model._sums_of_words, 1000).toPandas()
    assert sum(np.frombuffer(c, dtype=np.int64)[0] for c in found[found.kind == word_counts.SUMS].counts) == want[word_counts.WORDS].total()
    by = {k: pa.Table.from_pandas(v, preserve_index=False) for k, v in found.groupby("owner")}
    for kind, group, keys in held:
        assert word_counts.answered(by[group], kind, keys, ranges[kind]).tolist() == [want[kind][k] for k in keys.tolist()]


def slow_mixer(texts, held):
    """log10 probability of each text by plain loops: one group, one block."""
    L = language_model
    lines = [WORD.findall(lower(t)) + [None] for t in texts]
    train = [w for w, h in zip(lines, held) if not h]
    count = Counter(x for w in train for x in w[:-1])
    hashed = {x: int(L.Tokens(pa.array([x])).hash.view(np.int64)[0]) for w in lines for x in w[:-1]}
    octave = lambda c: int(L._octave(np.array([c]))[0])
    tops = sorted(((c, x) for x, c in count.items() if c > 1), key=lambda p: (-p[0], hashed[p[1]]))[: L.TOP]
    octaves, trained = np.zeros(L.OCTAVES + 1, dtype=np.int64), np.zeros(L.OCTAVES + 1, dtype=np.int64)
    for c in count.values():
        octaves[octave(c) - L.TOP] += c
        trained[octave(c - 1) - L.TOP] += c
    v = L.Vocabulary(sum(count.values()), len(count), len(train), octaves.copy(), trained.copy(), [(hashed[x], c) for c, x in tops])
    rank = {x: k for k, (_, x) in enumerate(tops)}
    sign = lambda x, out: L.END if x is None else rank[x] if x in rank else octave(count[x] - out)

    def plan(w, out):
        """(token, symbol, hit, run, open, contexts) of a line."""
        symbols, rows, run = [sign(x, out) for x in w], [], 0
        for k, x in enumerate(w):
            one = symbols[k - 1] if k else L.END
            two = symbols[k - 2] if k > 1 else L.END
            often = [s for s in symbols[:k] if s < L.TOP]
            far = (often[-1] if often else L.END) * L.SYMBOLS + (often[-2] if len(often) > 1 else L.END)
            past = [j for j in range(1, k) if w[j - 1] == w[k - 1]] if k else []
            open_ = bool(past)
            hit = open_ and w[past[-1]] == x
            rows.append((x, symbols[k], hit, min(run, L.FOLLOW - 1), open_, (one, two, far)))
            run = run + 1 if hit else 0
        return rows

    def bits(symbol, context):
        a, b = v.nodes.at[symbol], v.nodes.at[symbol + 1]
        one, two, far = context
        for node, bit in zip(v.nodes.flat[a:b].tolist(), v.bits.flat[a:b].tolist()):
            hashed_slot = lambda c: int(L._slot(np.array([c]), np.array([node]))[0])
            yield node, bit, (("0", node), ("1", one, node), ("2", hashed_slot(two * L.SYMBOLS + one)), ("3", hashed_slot(far + (1 << 40))))

    table, follow = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for w in train:
        for _, symbol, hit, run, open_, context in plan(w, 1):
            if open_:
                follow[run][hit] += 1
            if not hit:
                for _, bit, slots in bits(symbol, context):
                    for s in slots:
                        table[s][bit] += 1

    def stretch(s):
        n0, n1 = table[s] if s in table else (0, 0)
        return 0.0 if n0 + n1 < 3 else math.log((n1 + 0.3) / (n0 + 0.3)) * (n0 + n1) / (n0 + n1 + 1.5)

    seen = lambda s: 0 if s not in table else (sum(table[s]) >= 3) + (sum(table[s]) >= 40)
    order = sorted(range(len(lines)), key=lambda i: held[i])
    plans = {i: plan(lines[i], 0) for i in order}
    cost = {i: [0.0] * len(lines[i]) for i in order}
    weights, delta, own = np.tile(L.START.astype(float), (L.GATES, 1)), np.zeros((len(lines), L.INPUTS)), defaultdict(lambda: [0, 0])
    low, step = 0, L.FIRST_STEP
    while low < max(map(len, lines)):
        push = [np.zeros((L.GATES, L.INPUTS)), np.zeros((L.GATES, L.INPUTS))]
        mine, fresh = defaultdict(lambda: np.zeros((2, L.INPUTS))), []
        for i in order:
            for k, (x, symbol, hit, run, open_, context) in enumerate(plans[i][low : low + step], low):
                if open_:
                    yes = (follow[run][1] + 0.5) / (sum(follow[run]) + 1)
                    cost[i][k] -= math.log2(yes if hit else 1 - yes)
                if hit:
                    continue
                if x is not None and L.TOP <= symbol < L.UNSEEN:
                    cost[i][k] += math.log2(max(v.octave_tokens[symbol - L.TOP], count[x]) / count[x])
                for node, bit, slots in bits(symbol, context):
                    n0, n1 = own[i, node]
                    inputs = np.array([*map(stretch, slots), math.log((n1 + 0.4) / (n0 + 0.4)) * (n0 + n1) / (n0 + n1 + 2)])
                    gate = seen(slots[2]) * 2 + (seen(slots[3]) > 1)
                    p = min(max(1 / (1 + math.exp(-min(max(((weights[gate] + delta[i]) * inputs).sum(), -9), 9))), 1e-4), 1 - 1e-4)
                    cost[i][k] -= math.log2(p if bit else 1 - p)
                    e, s = (bit - p) * inputs, p * (1 - p) * inputs**2
                    if not held[i]:
                        push[0][gate] += e
                        push[1][gate] += s
                    mine[i] += [e, s]
                    fresh.append((i, node, bit))
        weights += 0.25 * push[0] / (push[1] + 200)
        for i, (e, s) in mine.items():
            delta[i] = 0.98 * delta[i] + 0.1 * e / (s + 30)
        for i, node, bit in fresh:
            own[i, node][bit] += 1
        low, step = low + step, min(2 * step, L.LAST_STEP)
    grams = Counter()
    for w in train:
        padded = ["^", *w]
        for n in (1, 2, 3):
            grams.update(tuple(padded[k : k + n]) for k in range(len(padded) - n + 1))
    out = []
    for i, w in enumerate(lines):
        padded, total = ["^", *w], 0.0
        for k, bits_ in enumerate(cost[i]):
            p, left = 2.0**-bits_, 0 if held[i] else 1
            for (a, b), size in zip(L.FOLLOWERS, (1, 2)):
                if k + 1 >= size:
                    n = grams[tuple(padded[k + 1 - size : k + 1])] - left
                    c = grams[tuple(padded[k + 1 - size : k + 2])] - left
                    if n > 0:
                        s = a * n**b
                        p = (c + s * p) / (n + s)
            total += math.log10(p)
        out.append(total)
    return out


def test_language_model_equals_slow_loops(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{k}" for k in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(vocabulary, n, p=share / share.sum())) for n in (0, 1, 5, 80, 300, 120, 33, 64, 90, 200)]
    texts[7] += " never seen words here never seen"
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(10)]
    if not any(held):
        held[7] = True
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in language_model.score_documents(rows).collect()}
    for i, expected in enumerate(slow_mixer(texts, [got[i].held_out for i in range(10)])):
        assert got[i].score == pytest.approx(expected, rel=2e-3, abs=1e-3)


def test_language_model_does_not_learn_from_held_out_texts(spark, small):
    held = quality.held_out(F.col("doc_id"), 7, 2)
    other = small.withColumn("text", F.when(held, F.concat(F.lit("foreign words "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    # with one group of documents: groups are cut by size, and what they learn on the way stays in them
    a, b = ({r.doc_id: r.score for r in language_model.score_documents(x).filter(~F.col("held_out")).collect()} for x in (small, other))
    assert a == b


def test_language_model_spells_unseen_words(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2]
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(300) if i not in held]
    rows += [(held[0], "abcfgh " * 3 + "hgfe"), (held[1], "zqxjkv " * 3 + "vkjx")]
    got = {r.doc_id: r for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a.bits < b.bits and a.bits > -a.score / math.log10(2) and a.bits_per_byte == pytest.approx(a.bits / 25)


def test_language_model_contexts_are_distributions():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(50))
    pair, triple = rng.integers(0, 9, 50), rng.integers(0, 3, 50)
    for a, b in ((pair, triple), (pair, triple * 0), (pair * 0, triple * 0)):
        bits = language_model.with_contexts(-np.log2(p), [(np.full(50, a.sum()), a), (np.full(50, b.sum()), b)])
        assert (2.0 ** -bits).sum() == pytest.approx(1)


# 2
def test_mixing(spark, docs, edges, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    size = {i: len(WORD.findall(t or "")) for i, t in text_of(docs)}
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 3
        b = by[r.source]
        b[0] += r.size
        b[1] += r.size * r.copies
        b[2] = r.target
        b[3] = max(b[3], r.size)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(b[0] for b in by.values()), {}, set(names)
    while True:  # shares again and again, as the contract says
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * by[s][0]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * by[s][0] for s in over}
        open_ -= over
    for s, (full, taken, goal, largest) in by.items():
        assert goal == pytest.approx(target[s]) and abs(taken - goal) <= largest / 2 + 1e-6 and (s is not None or full == 0)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(edges)
    assert out.columns == edges.columns
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("run", [mixing.RUN, 7])
def test_mixing_of_repeated_rows(spark, run, monkeypatch):
    """A row that is there 500 times, null ids of one size: whole, near the target, in chunks of like size."""
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(1, "four words are here", "a", 5)] * 500 + [(None, f"t{k} u v", "b", k) for k in range(90)] + [(k + 10, "x " * (k % 9 + 1), "c", 1) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source][0] += r.size * r.copies
        by[r.source][1] = r.target
    assert all(abs(taken - goal) <= 5 for taken, goal in by.values())
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in got)
    again = mixing.mix(d.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in got) == Counter((r.doc_id, r.size, r.copies) for r in again)


# 3
def test_token_counts(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect()))
    expected = sorted((i or -1, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in text_of(docs))
    assert got == expected and token_counts.count_tokens(empty).count() == 0


# 4
def test_personal_data(docs, empty):
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in personal_data.find_all(docs).collect()}
    for i, t in text_of(docs):
        b = personal_data.base_spans(t or "")
        k = Counter(x for x, _, _ in b)
        assert (i, hashlib.sha256(personal_data.join_spans(b).encode()).hexdigest(), *(k[x] for x in personal_data.KINDS)) in got
    assert personal_data.find_all(empty).count() == 0


def test_personal_data_finds_all_of_every_row(spark, docs):
    mixed = [(k, t, "en", "src0", 0) for k, t in enumerate(MIXED, 20000)]
    rows = docs.unionByName(spark.createDataFrame(mixed, docs.schema))
    got = Counter((r.doc_id, r.spans, r.n_added) for r in personal_data.find_all(rows).collect())
    want = Counter()
    for i, t in text_of(rows):
        b, added = personal_data.find_personal_data(t or "")
        want[i, personal_data.join_spans(b + added), len(added)] += 1
    assert got == want
    assert sum(n for i, _, n in got if i in range(20000, 20003)) == 3


# 5
def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(text_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    start = 0
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    c = spark.read.parquet(f"{path}/containers").orderBy("part", "seq").first()
    raw = spark.read.parquet(f"{path}/dictionary").first()["bytes"]
    assert token_files.read_document(c.blob, 3, bytes(raw)).tolist() == t.encode(rows[3][1], add_special_tokens=False).ids + [0]
    with pytest.raises(ValueError):
        token_files.unpack(b"nope" + bytes(40))
    assert token_files.token_output(empty).count() == 0


def test_ids_of_large_vocabularies_take_four_bytes(spark, edges, tmp_path, monkeypatch):
    assert token_files.id_bytes("byte_bpe_50k.json", 0) == 2 and token_files.id_bytes("byte_bpe_50k.json", 70000) == 4
    path = f"file://{tmp_path}/wide"
    token_files.write_tokens(edges, path, end_id=70000)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    assert len(got) + 1 == edges.count() and got[9001].ids_crc32 == zlib.crc32(np.array([70000], dtype="<u4").tobytes())
    blob = spark.read.parquet(f"{path}/containers").orderBy("part", "seq").first().blob
    assert token_files.unpack(blob)[0] == 4


def test_session_settings_stay(spark, edges):
    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    token_counts.count_tokens(edges).collect()
    near_duplicates.near_duplicates(edges).collect()
    token_files.token_output(edges).collect()
    assert [spark.conf.get(k) for k in keys] == before


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(token_counts.Counter, "count", lambda self, data, offsets: np.zeros(len(offsets) - 1, dtype=int))
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))


def test_clashing_columns_are_not_read(edges, benchmark):
    """Operators that return digests look at doc_id and text only."""
    plain = edges.select("doc_id", "text", "source")
    for f in (token_counts.count_tokens, personal_data.find_all, token_files.token_output, fingerprints.compare_neighbours, lambda d: decontaminate.digests(decontaminate.find_contamination(d, benchmark)), mixing.mix):
        a, b = (Counter(map(str, f(d).collect())) for d in (edges, plain))
        assert a == b and a.total() == edges.count()


# 6
def contamination(rows, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = pattern.findall(lower(t))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((i if i is not None else -1, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out)


def test_longest_match_follows_one_item(spark):
    item = lambda n: " ".join(f"i{n}w{k}" for k in range(14))
    items = spark.createDataFrame([(1, item(1)), (2, item(2)), (3, item(1) + " more words of it")], "item_id bigint, text string")
    both = " ".join(item(1).split()[:10] + item(2).split()[:10])
    rows = spark.createDataFrame([(1, both), (2, "x " + item(1) + " more words y " + item(1)), (3, "i1w0 " * 30)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(rows, items).collect()}
    assert (got[1].n_hit, got[1].longest, got[3].longest, got[3].longest_item) == (20, 10, 0, None)
    assert (got[2].longest, got[2].longest_at, got[2].longest_item, got[2].longest_item_at) == (16, 1, "3", 0)


def longest_common(doc, items, size=10):
    """(length, first word, item, first word in it) of the longest run that holds a window, by all pairs of places."""
    best = None
    for name, w in items:
        least = min(size, len(w))
        for i in range(len(doc)):
            for j in range(len(w)):
                if i and j and doc[i - 1] == w[j - 1]:
                    continue
                n = 0
                while i + n < len(doc) and j + n < len(w) and doc[i + n] == w[j + n]:
                    n += 1
                if least and n >= least:
                    best = min(best, (-n, i, name, j)) if best else (-n, i, name, j)
    return best


@pytest.mark.parametrize("pairs", [1, 7, 100, 1 << 20])
def test_longest_match_in_parts(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = np.random.default_rng(9)
    items = [("a", "x " * 30), ("b", "x y " * 12), ("c", "short one"), ("d", "x x x z"), ("b", "x y " * 12), ("e", " ".join(rng.choice(list("xy"), 40)))]
    docs = ["x " * 45, "y " + "x y " * 9 + "z", "a short one x x x z", " ".join(rng.choice(list("xyz"), 60)), "", "x x x z " * 3 + "x " * 12]
    shard = decontaminate.Shard(pa.array(docs), 10)
    shard.look_up(decontaminate.Windows(items, 10))
    for d, text in enumerate(docs):
        best = longest_common(text.split(), [(i, t.split()) for i, t in items])
        got = shard.longest.get(d)
        assert (got is None) == (best is None) and (got is None or (got[0], got[1]) == (-best[0], best[1])), (d, got, best)
        assert shard.items.get(d, set()) == {i for i, t in items if longest_common(text.split(), [(i, t.split())])}


def test_long_runs_of_one_word_take_bounded_memory():
    import tracemalloc

    block = decontaminate.Windows([("i", "w " * 5000), ("j", "v")], 10)
    column = pa.array(["w " * 20_000])
    tracemalloc.start()
    shard = decontaminate.Shard(column, 10)
    shard.look_up(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shard.longest[0] == (5000, 0, "i", 0) and shard.items[0] == {"i"} and shard.n_hit()[0] == 20_000
    assert peak < 300e6


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 1500, 100])
def test_decontamination(spark, docs, benchmark, edges, empty, block):
    more = spark.createDataFrame([(900, "again and"), (901, ""), (902, None), (None, "few words again"), (903, "One"), (900, "again and")], "item_id bigint, text string")
    items = benchmark.select("item_id", "text").unionByName(more)
    if block == 100:  # more blocks than a worker keeps
        assert len(decontaminate._sent(items, 10, block)) > decontaminate.KEEP
    found = decontaminate.find_contamination(docs.withColumn("n_words", F.lit("clash")), items, 10, block)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digests(found).collect())
    expected = contamination(text_of(docs), [(r.item_id, r.text) for r in items.collect()])
    assert got == expected
    lines, pattern = [(("" if r.item_id is None else str(r.item_id)), re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))) for r in items.collect()], re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in found.join(docs.select("doc_id", "text").distinct(), "doc_id").filter("longest > 0 or n_words < 400").collect():
        w, best = pattern.findall(lower(r.text)), 0
        for _, item in lines:
            ends = [0] * (len(item) + 1)
            for x in w:  # longest common runs that end here
                ends = [0, *(ends[k] + 1 if x == item[k] else 0 for k in range(len(item)))]
                best = max(best, max((e for e in ends if e >= min(10, len(item))), default=0))
        assert r.longest == best
        if best:
            assert any(i == r.longest_item and item[r.longest_item_at : r.longest_item_at + best] == w[r.longest_at : r.longest_at + best] for i, item in lines)
    left = decontaminate.remove_contaminated(edges, items, 10, block)
    assert left.columns == edges.columns and left.count() == sum(not x[-1] for x in contamination(text_of(edges), [(r.item_id, r.text) for r in items.collect()]))
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.remove_contaminated(docs, more.limit(0)).count() == docs.count()


# 7
def duplicate_groups(rows, size=4, percent=80):
    sets, holders, parent = {}, defaultdict(list), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = WORD.findall(lower(t))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        if i is None:
            continue
        parent.setdefault(i, i)
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        if i not in sets:
            sets[i] = s
            for x in s:
                holders[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(spark, n=260):
    """Many near copies of one text, most of them linked, and texts that share a passage only."""
    import random

    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(4000)]
    one, passage = rng.choices(vocabulary, k=150), rng.choices(vocabulary, k=20)
    rows = []
    for k in range(n):
        w = list(one)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((20000 + k, " ".join(w)))
    rows += [(30000 + k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)) + passage)) for k in range(120)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def templates(spark, n=320):
    """Texts of one template, alike but mostly not linked."""
    import random

    rng = random.Random(9)
    one = [f"t{k}" for k in range(110)]
    rows = []
    for k in range(n):
        w = list(one)
        for place in rng.sample(range(110), rng.randint(1, 5)):
            w[place] = f"o{k}x{place}"
        rows.append((40000 + k, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("sizes", [(8, 256, 48 << 20), (3, 20, 40_000), (2, 2, 10_000)])
def test_near_duplicates(spark, docs, edges, empty, sizes, monkeypatch):
    """Buckets of all kinds: held pair by pair, as one block, and as teams in one or several slices."""
    for name, value in zip(("TINY", "SMALL", "BLOCK_BYTES"), sizes):
        monkeypatch.setattr(near_duplicates, name, value)
    table = docs.select("doc_id", "text").unionByName(near_copies(spark)).unionByName(templates(spark))
    got = near_duplicates.near_duplicates(table.withColumn("n", F.lit("clash")).withColumn("rep", F.lit("clash"))).collect()
    expected = duplicate_groups(text_of(table))
    assert len(got) == table.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)
    if sizes[0] > 2:
        return
    kept = near_duplicates.drop_near_duplicates(edges)
    groups = duplicate_groups(text_of(edges), 5)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, *(i for i, (_, g) in groups.items() if i == g)])
    assert near_duplicates.near_duplicates(empty).count() == 0
    # two texts under one doc_id are one vertex
    two = spark.createDataFrame([(5, "a b c d e f"), (7, "a b c d e f"), (7, "p q r s t u"), (9, "p q r s t u")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(two).collect()} == {(5, 5), (7, 5), (9, 5)}


def test_small_sets_that_all_bands_miss_are_linked(spark):
    """Texts of 7 words and the same with one more, before or after: 4 and 5 shingles, 4 in common."""
    first = [[f"a{k}_{j}" for j in range(7)] for k in range(4000)]
    second = [["more", *w] if k % 2 else [*w, "more"] for k, w in enumerate(first)]
    texts = pa.array([" ".join(w) for w in first + second])
    keys = near_duplicates.band_keys(near_duplicates.registers(near_duplicates.distinct_shingles(*buffers(texts), 4)))
    missed = np.flatnonzero(~(keys[:4000] == keys[4000:]).any(axis=1))
    assert len(missed)
    rows = [(int(k), " ".join(first[k])) for k in missed] + [(int(k) + 10000, " ".join(second[k])) for k in missed]
    # one short text with many others that are it and a word: each is linked with it, none of them with each other
    rows += [(20000, "p q r s t u v"), *((20001 + k, f"p q r s t u v x{k}") for k in range(600))]
    # 3 of 4 shingles are below the threshold; a permutation has no shingle in common
    rows += [(30000, "k l m n o p"), (30001, "k l m n o p q"), (30002, "q p o n m l k"), (30003, "k l m n o p q r")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    expected = duplicate_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(expected[int(k) + 10000][1] == k for k in missed) and expected[20600][1] == 20000 and expected[30001][1] == 30001


# 8
def test_fingerprints(docs, empty):
    whole = fingerprints.compare_neighbours(docs).collect()
    assert len(whole) == docs.count() and sum(r.doc_id == 9003 for r in whole) == 2
    assert sorted(r.near_next for r in whole if r.doc_id == 9003)[1] == 1 and len({r.fingerprint for r in whole if r.doc_id == 9003}) == 1
    got = fingerprints.compare_neighbours(docs.filter("doc_id is null or doc_id != 9003")).collect()
    rows = sorted(text_of(docs.filter("doc_id is null or doc_id != 9003")), key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)]
        n = len(t) // 3
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + (after[1] or "")[:n]).encode()).hexdigest()
        y = t[: len(t) - n] + (after[1] or "")[:n]
        a, b, c = (by[i][k] for k in fingerprints.EDIT)
        assert (a is None) == (t == y) and (a is None or t[:a] + y[a:c] + t[b:] == y)
        assert by[i].near_next == pytest.approx(fingerprints.likeness_of(by[i].fingerprint, by[after[0]].fingerprint))
        assert by[i].near_edited == pytest.approx(fingerprints.likeness_of(by[i].fingerprint, by[i].edited_fingerprint))
    assert fingerprints.compare_neighbours(empty).count() == 0
    assert fingerprints.fingerprint(docs).count() == docs.count()


def test_edits_between_tables(edges, empty):
    after = edges.withColumn("text", F.concat(F.lit("so "), F.col("text"))).withColumn("edited", F.lit("clash"))
    got = [tuple(r) for r in fingerprints.locate_edits(edges, after).collect()]
    assert len(got) == edges.filter("doc_id is not null").count() + 2  # the repeated row meets both of its kind
    at = {r[0]: r[1:] for r in got}
    assert at[9000] == (None, None, None) and at[9001] == (0, 0, 3) and all(r[1] == 0 and r[3] == r[2] + 3 for r in got if r[1] is not None)
    assert {r[1:] for r in (tuple(r) for r in fingerprints.locate_edits(edges.filter("doc_id != 9003"), edges).collect())} == {(None, None, None)}
    assert fingerprints.locate_edits(edges, empty).count() == fingerprints.locate_edits(empty, edges).count() == 0


# 9 and 10
def test_classifiers(spark, small, edges, labels, empty):
    big = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    marks = spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    q = quality.score_quality(big, marks).join(marks, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"), 5, 0))
    right = q.select(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double").alias("ok"), "held")
    assert right.filter("held").agg(F.avg("ok")).first()[0] > 0.93
    t = toxicity.score_toxicity(big, marks).join(marks, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"), 4, 2))
    right = t.select(((F.col("score") >= 0.3).cast("int") == F.col("toxic")).cast("double").alias("ok"), "held")
    assert right.filter("held").agg(F.avg("ok")).first()[0] > 0.93
    for score in (quality.score_quality, toxicity.score_toxicity):
        rows = score(edges, labels).collect()
        assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
        assert score(empty, labels).count() == 0
        assert all(0 <= r.score <= 1 for r in score(edges, labels.limit(0)).collect())
    kept = quality.keep_good(edges, marks)
    assert kept.columns == edges.columns


def test_labels_of_held_out_rows_do_not_matter(spark, small, labels):
    held = quality.held_out(F.col("doc_id"), 4, 2)
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(small, x).collect()} for x in (labels, other))
    assert a == b
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(small, x).collect()} for x in (labels, other))
    assert a == b


# pipeline
def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "mixing_sources", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        if name == "minhash_near_dedup":
            groups = duplicate_groups(text_of(before), 5)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, g) in groups.items() if i == g)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in contamination(text_of(before), items) if not x[-1]]
    out = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert sorted(r.start for r in out)[0] == 0


def test_every_query_is_registered(spark):
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_labels_that_repeat_count_once_each(small, labels):
    """Every label twice is the same classifier; a contradicting label is one more row of the other class."""
    score = lambda y: {r.doc_id: r.score for r in quality.score_quality(small, y).collect()}
    once, twice = score(labels), score(labels.unionByName(labels))
    assert once.keys() == twice.keys() and all(once[k] == pytest.approx(twice[k], abs=1e-3) for k in once)
    other = labels.limit(3).select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic")
    assert len(score(labels.unionByName(other))) == len(once)
