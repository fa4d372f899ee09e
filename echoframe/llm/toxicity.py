"""Toxicity by weak supervision.

Voters look at every whole text: lexicon voters (one per insult, in plain and in
digit-disguised spelling), stem voters (word beginnings that mark toxic rows of a
bounded sample of labelled rows) and pattern voters.  A generative label model
explains their second moments over all documents: off the diagonal the covariance
of voters that are independent given the label is rank one, so triplets of voters
give each one's strength (its correlation with the hidden label) without any label.
A voter without three triplets (one that never fires beside two others, such as the
only stem of a language) can't be told this way; there the labels of rows that are
not held out are the other two voters, as their strength is 1: its strength is its
correlation with them.  What remains between two voters is their own correlation, by
which their evidence is discounted.  The label model's posteriors then train a linear
classifier (ridge-penalised logistic regression, Newton steps over all documents).

Defined results: null texts are empty; without usable labels the share of toxic
documents is 0.1 and there are no stem voters; where no voter fires, the classifier
gives the same low score to texts of the same length.  A document with several rows in
labels counts once for each of them.  doc_id is cast to a long, and an id that
is no number is an error.  An empty table gives an empty result; repeated rows are
scored each; very long texts are read whole; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix, rows, summed
from .quality import held_out
from .shared import pieces, written
from .text import ALNUM, LOWER, buffers, hash_words, words

# Insults and words of contempt in four languages.
LEXICON = (
    "idiot idiots idiotic stupid moron morons moronic trash garbage scum loser losers pathetic worthless disgusting clown clowns dumb "
    "fool fools imbecile jerk filth filthy pig pigs vermin coward cowards ugly creep freak lunatic retard bastard bitch shit fuck asshole "
    "hateful liar "
    "idiota idiotas estúpido estúpida imbécil basura asqueroso asquerosa payaso perdedor inútil patético mierda tonto cabrón "
    "idiote idiotes stupide imbécile crétin débile ordure ordures dégoûtant minable connard salaud pathétique merde clowne "
    "idioten dumm dummkopf blödmann abschaum müll versager erbärmlich wertlos widerlich schwachkopf arschloch scheiße drecksau"
).split()
#: Digits that stand for letters.
SPELLED = LOWER.copy()
SPELLED[list(b"013457")] = list(b"oieast")
PATTERNS = ("shouted_insult", "insult_repeated", "many_bangs", "mostly_upper")
#: Stem voters: places for them, bytes of a stem, and the firing rule (so many words, and so many of all words).
STEMS, STEM_BYTES = 48, range(4, 9)
STEM_WORDS, STEM_SHARE = 2, 0.004
#: Bound of the labelled rows (of each label) from which stems are taken, in the order of a hash of doc_id.
SAMPLE_ROWS = 6000
#: Share of toxic texts where every voter abstains, against the share in all texts.
SILENT = 0.25
VOTERS = len(LEXICON) + STEMS + len(PATTERNS)
#: What the linear classifier sees: a constant, the votes, insults per word, number of different insults, stem words per word, length.
WIDTH = 1 + VOTERS + 4

_hashes = np.array([h[0] for h in hash_words(list(LEXICON), ALNUM)], dtype=np.uint64)
_order = np.argsort(_hashes)
_sorted = _hashes[_order]


def _hits(data, offsets, fold):
    w = words(data, offsets, ALNUM, fold)
    at = np.minimum(np.searchsorted(_sorted, w.hash), len(_sorted) - 1)
    spot = np.flatnonzero(_sorted[at] == w.hash)
    return w, spot, _order[at[spot]]


def _beginnings(data, w) -> np.ndarray:
    """The first eight bytes of each word (zeros after its end) as a number, first byte highest."""
    out = np.zeros(len(w.start), dtype=np.uint64)
    last = max(len(data) - 1, 0)
    for k in range(8):
        at = w.start + k
        out = (out << np.uint64(8)) | np.where(at < w.end, LOWER[data[np.minimum(at, last)]] if len(data) else 0, 0).astype(np.uint64)
    return out


def _mask(length: int) -> np.uint64:
    return np.uint64((2**64 - 1) ^ (2 ** (64 - 8 * length) - 1))


def _stem_words(data, w, stems: list[tuple[int, int]]) -> np.ndarray:
    """Words of each document that begin with each stem; a stem is its length and its bytes as in _beginnings."""
    docs = len(w.first) - 1
    counts = np.zeros((docs, STEMS))
    begin = _beginnings(data, w) if stems else None
    for length in {n for n, _ in stems}:
        own = sorted((value, k) for k, (n, value) in enumerate(stems) if n == length)
        keys, place = np.array([v for v, _ in own], dtype=np.uint64), np.array([k for _, k in own])
        part = begin & _mask(length)
        at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
        spot = np.flatnonzero(keys[at] == part)
        np.add.at(counts, (np.searchsorted(w.first, spot, side="right") - 1, place[at[spot]]), 1)
    return counts


def measure(column: pa.Array, stems: list[tuple[int, int]] = ()) -> np.ndarray:
    """One row of WIDTH inputs per text; columns 1 to VOTERS are the votes (0 or 1)."""
    data, offsets = buffers(column)
    docs = len(offsets) - 1
    counts = np.zeros((docs, len(LEXICON)))
    w, spot, kind = _hits(data, offsets, LOWER)
    doc = np.searchsorted(w.first, spot, side="right") - 1
    np.add.at(counts, (doc, kind), 1)
    n = np.diff(w.first)
    if np.isin(data, np.frombuffer(b"013457", dtype=np.uint8)).any():
        _, spot2, kind2 = _hits(data, offsets, SPELLED)
        extra = ~np.isin(spot2, spot)  # the same words in the same places, but for what digits disguise
        doc2 = np.searchsorted(w.first, spot2[extra], side="right") - 1
        np.add.at(counts, (doc2, kind2[extra]), 1)
    stem = _stem_words(data, w, list(stems))
    stem = np.where((stem >= STEM_WORDS) & (stem >= STEM_SHARE * n[:, None]), stem, 0)
    pattern = np.zeros((docs, len(PATTERNS)))
    edge = lambda at: (data[at] > 64) & (data[at] < 91)
    shouted = np.zeros(docs)
    np.add.at(shouted, doc, edge(w.start[spot]) & edge(w.end[spot] - 1))
    pattern[:, 0] = shouted > 0
    pattern[:, 1] = (counts > 1).any(axis=1)
    size = np.maximum(np.diff(offsets), 1)
    bangs = np.concatenate([[0], np.cumsum(data == 33)])
    upper = np.concatenate([[0], np.cumsum((data > 64) & (data < 91))])
    pattern[:, 2] = (bangs[offsets[1:]] - bangs[offsets[:-1]]) > 0.02 * size
    pattern[:, 3] = (upper[offsets[1:]] - upper[offsets[:-1]]) > 0.5 * size
    share = lambda k: np.log1p(100 * k / np.maximum(n, 1))
    return np.column_stack([np.ones(docs), counts > 0, stem > 0, pattern, share(counts.sum(axis=1)), np.log1p((counts > 0).sum(axis=1)), share(stem.max(axis=1)), np.log1p(n) / 10])


def choose_stems(found: list[tuple[int, int, int, int]], toxic: int, clean: int) -> list[tuple[int, int]]:
    """Up to STEMS stems from (length, bytes, toxic rows, clean rows), by likelihood ratio; none that begins with a chosen one or the other way round."""
    def gain(a, b):
        p = (a + b) / (toxic + clean)
        part = lambda k, n: k * np.log((k + 0.1) / (n * p)) + (n - k) * np.log(max(n - k, 0.1) / (n * (1 - p)))
        return part(a, toxic) + part(b, clean)

    ranked = sorted(((-gain(a, b), n, v) for n, v, a, b in found if a >= 4 and a * clean > 4 * b * toxic and a + b < toxic + clean))
    out: list[tuple[int, int]] = []
    for g, n, v in ranked:
        if len(out) == STEMS or -g < 15:
            break
        if not any((v & int(_mask(min(n, m)))) == (u & int(_mask(min(n, m)))) for m, u in out):
            out.append((n, v))
    return out


def find_stems(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int) -> list[tuple[int, int]]:
    """Stems from the first SAMPLE_ROWS labelled rows of each label, by a hash of doc_id, that are not held out."""
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("doc_id"), mod, rest))
    order = F.xxhash64("doc_id")
    y = y.filter("y = 1").orderBy(order, "doc_id").limit(SAMPLE_ROWS).union(y.filter("y = 0").orderBy(order, "doc_id").limit(SAMPLE_ROWS))

    def run(batches):
        for batch in pieces(batches):
            data, offsets = buffers(batch.column("text"))
            w = words(data, offsets, ALNUM)
            begin, size = _beginnings(data, w), w.end - w.start
            toxic = batch.column("y").to_numpy(zero_copy_only=False)
            for length in STEM_BYTES:
                keys, rows_of = [], []
                for d in range(batch.num_rows):
                    a, b = w.first[d], w.first[d + 1]
                    v, k = np.unique((begin[a:b] & _mask(length))[size[a:b] >= length], return_counts=True)
                    keys.append(v[(k >= STEM_WORDS) & (k >= STEM_SHARE * (b - a))])
                    rows_of.append(np.full(len(keys[-1]), toxic[d]))
                if keys:
                    v, at = np.unique(np.concatenate(keys), return_inverse=True)
                    ones = np.bincount(at, weights=np.concatenate(rows_of), minlength=len(v))
                    every = np.bincount(at, minlength=len(v))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), length)), pa.array(v.view(np.int64)), pa.array(ones.astype(np.int64)), pa.array((every - ones).astype(np.int64))], ["n", "v", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([0, 1]), pa.array([int(toxic.sum()), 0]), pa.array([0, int(len(toxic) - toxic.sum())])], ["n", "v", "a", "b"])

    sums = docs.select("doc_id", "text").join(y, "doc_id").mapInArrow(run, "n long, v long, a long, b long").groupBy("n", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = written(sums.filter("a >= 4 or n = 0"), "stems")
    totals = {r.v: (r.a, r.b) for r in sums.filter("n = 0").collect()}
    toxic, clean = totals.get(0, (0, 0))[0], totals.get(1, (0, 0))[1]
    if not toxic or not clean:
        return []
    # by lift first: a bounded list, whatever the size of the sample
    best = sums.filter("n > 0").filter(F.col("a") * clean > 4 * F.col("b") * toxic).orderBy(F.desc("a"), "b", "n", "v").limit(5000).collect()
    return choose_stems([(r.n, r.v & (2**64 - 1), r.a, r.b) for r in best], toxic, clean)


class LabelModel:
    """Class-conditional firing rates of the voters, from first and second moments over all documents.

    `known` are correlations with known labels, for voters that triplets don't determine (without it, these have no say).
    """

    def __init__(self, count: float, first: np.ndarray, second: np.ndarray, prior: float, known: np.ndarray | None = None):
        mean = first / max(count, 1)
        cov = second / max(count, 1) - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        live = np.diag(cov) > 1e-9
        r = np.where(np.outer(live, live), cov / np.outer(sd, sd), 0)
        np.fill_diagonal(r, 0)
        strength = np.zeros(len(mean)) if known is None else np.where(live, known, 0.0)
        for i in np.flatnonzero(live):
            friends = np.argsort(-r[i])[:16]
            friends = friends[r[i, friends] > 0.05]
            guesses = [r[i, j] * r[i, k] / r[j, k] for a, j in enumerate(friends) for k in friends[a + 1 :] if r[j, k] > 0.05]
            if len(guesses) >= 3:
                strength[i] = np.sqrt(np.clip(np.median(guesses), 0, 0.9))
        strength = np.clip(strength, -0.9, 0.95)
        rest = r - np.outer(strength, strength)
        np.fill_diagonal(rest, 0)
        self.strength, self.correlations = strength, np.where(np.abs(rest) > 0.1, rest, 0)
        gap = strength * sd / np.sqrt(prior * (1 - prior))
        given_toxic = np.clip(mean + (1 - prior) * gap, 1e-4, 0.999)
        given_clean = np.clip(mean - prior * gap, 1e-4, 0.999)
        discount = 1 / (1 + np.maximum(self.correlations, 0).sum(axis=1))
        self.fired = np.where(live, discount * np.log(given_toxic / given_clean), 0)
        # a silent voter abstains: voters of other languages are silent for another reason than a clean text
        self.bias = np.log(SILENT * prior / (1 - SILENT * prior))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + votes @ self.fired, -12, 12)))


def _moments(batch):
    votes = matrix(batch.column("x"), WIDTH)[:, 1 : 1 + VOTERS]
    return {0: np.concatenate([[len(votes)], votes.sum(axis=0), (votes.T @ votes).reshape(-1)])}


def _known_moments(batch):
    votes, y = matrix(batch.column("x"), WIDTH)[:, 1 : 1 + VOTERS], batch.column("y").to_numpy(zero_copy_only=False).astype(float)
    return {0: np.concatenate([[len(y), y.sum()], votes.sum(axis=0), votes.T @ y])}


def known_correlations(sums: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of toxic rows and each voter's correlation with the label, from the sums over labelled rows."""
    n, ones, fired, both = sums[0], sums[1], sums[2 : 2 + VOTERS], sums[2 + VOTERS :]
    p, m = ones / n, fired / n
    sd = np.sqrt(np.maximum(m * (1 - m) * p * (1 - p), 1e-12))
    return float(np.clip(p, 0.005, 0.5)), np.where((m > 0) & (p > 0), (both / n - m * p) / sd, 0)


def _newton(features: DataFrame, label_model: LabelModel, steps: int = 6, ridge: float = 1.0) -> np.ndarray:
    spark = features.sparkSession
    beta = np.zeros(WIDTH)
    for _ in range(steps):
        now = spark.sparkContext.broadcast((beta, label_model))

        def part(batch):
            beta, model = now.value
            x = matrix(batch.column("x"), WIDTH)
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            q = model.posterior(x[:, 1 : 1 + VOTERS])
            return {0: np.concatenate([x.T @ (q - p), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)])}

        sums = summed(features, part, WIDTH + WIDTH * WIDTH).get(0)
        if sums is None:
            break
        step = np.linalg.solve(sums[WIDTH:].reshape(WIDTH, WIDTH) + ridge * np.eye(WIDTH), sums[:WIDTH] - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-3:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    spark = docs.sparkSession
    stems = find_stems(docs, labels, "toxic", mod, rest)

    def run(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), rows(measure(batch.column("text"), stems))], ["doc_id", "x"])

    features = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>"), "votes")
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("doc_id"), mod, rest))
    known = summed(features.join(y, "doc_id"), _known_moments, 2 + 2 * VOTERS).get(0)
    prior, correlation = (0.1, None) if known is None else known_correlations(known)
    size = 1 + VOTERS + VOTERS * VOTERS
    sums = summed(features, _moments, size).get(0, np.zeros(size))
    model = LabelModel(sums[0], sums[1 : 1 + VOTERS], sums[1 + VOTERS :].reshape(VOTERS, VOTERS), prior, correlation)
    beta = spark.sparkContext.broadcast(_newton(features, model))

    def score(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(matrix(batch.column("x"), WIDTH) @ beta.value, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return features.mapInArrow(score, "doc_id long, score double")
