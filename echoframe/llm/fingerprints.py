"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

A text is cut into phrases (leaves) at words whose hash says so, so that the cuts
follow the content and agree again after an edit; lines are paragraphs, and blank
lines, or paragraphs whose hash says so, end sections.  Leaves cover every byte,
each node hashes its children in order, and the root stands for the text: equal
texts have equal fingerprints.  The fingerprint is a string

    root/section:paragraph=leaves,paragraph=leaves;section:...

(root 16, section and paragraph 8 hexadecimal digits; four base64 signs a leaf), so
that two of them show where texts differ, and the share of common leaves (Dice, with
repetitions) is their likeness.  Trees of two versions of a text also locate the edit:
from the roots down, the first and last children that differ lead to the leaves between
which all differences lie.  A null text is an empty one; two texts without leaves are
alike (1); equal texts have no edit (nulls).  doc_id is cast to a long; an empty table gives an
empty result; very long texts are cut whole; repeated rows are rows of their own; further
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import hash_spans
from .shared import pieces
from .text import IDENTITY, NOT_SPACE, U64, buffers, mix64, words

PHRASE, LONGEST, SECTION = 4, 16, 8
_SALT = U64(0x5851F42D4C957F2D)


class Forest:
    """The trees of a buffer of texts: bounds of leaves, paragraphs and sections, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        docs = len(offsets) - 1
        self.data, self.offsets = data, offsets
        w = words(data, offsets, NOT_SPACE, IDENTITY)
        n = np.diff(w.first)
        # a phrase starts after a word with the right hash, at a line break, after LONGEST words, and with each text
        start = np.zeros(len(data) + 1, dtype=bool)
        start[offsets[:-1]] = offsets[1:] > offsets[:-1]
        after = np.flatnonzero(data == 10) + 1
        line = np.zeros(len(data) + 1, dtype=bool)
        line[after] = True
        line[offsets] = True
        start[after] = True
        if len(w.hash):
            doc = np.repeat(np.arange(docs), n)
            cut = ((mix64(w.hash ^ _SALT) % U64(PHRASE)) == 0) | (n[doc] < 2 * PHRASE)
            inner = np.ones(len(w.hash), dtype=bool)
            inner[w.first[:-1][n > 0]] = False
            follows = np.flatnonzero(cut[:-1] & inner[1:]) + 1
            start[w.start[follows]] = True
            # no phrase longer than LONGEST words: cut again inside long ones
            bounds = np.flatnonzero(start[:-1])
            leaf = np.searchsorted(bounds, w.start, side="right") - 1
            new = np.append(True, leaf[1:] != leaf[:-1])
            place = np.arange(len(leaf)) - np.maximum.accumulate(np.where(new, np.arange(len(leaf)), 0))
            start[w.start[(place > 0) & (place % LONGEST == 0)]] = True
        start[offsets[offsets == len(data)]] = False
        self.starts = np.flatnonzero(start[: len(data)])
        self.ends = np.append(self.starts[1:], len(data))
        self.leaf = hash_spans(data, self.starts, self.ends)
        self.leaf_at = np.searchsorted(self.starts, offsets)
        # paragraphs: leaves that start lines
        self.paragraph_first = np.flatnonzero(line[self.starts]) if len(self.starts) else np.zeros(0, np.int64)
        self.paragraph = self._fold(self.leaf, self.paragraph_first)
        self.paragraph_at = np.searchsorted(self.paragraph_first, self.leaf_at)
        head = np.zeros(len(self.paragraph_first), dtype=bool)
        head[self.paragraph_at[:-1][np.diff(self.paragraph_at) > 0]] = True
        if len(head):
            begins = self.starts[self.paragraph_first]
            stops = np.append(begins[1:], len(data))
            blank = (stops - begins == 1) & (data[begins] == 10)
            head[1:] |= blank[:-1] | ((mix64(self.paragraph ^ _SALT) % U64(SECTION)) == 0)[:-1]
        self.section_first = np.flatnonzero(head)
        self.section = self._fold(self.paragraph, self.section_first)
        self.section_at = np.searchsorted(self.section_first, self.paragraph_at)
        # bounds of the children of each section and paragraph, and of the bytes of each leaf
        self.bounds = {"section": np.append(self.section_first, len(self.paragraph)), "paragraph": np.append(self.paragraph_first, len(self.leaf)), "leaf": np.append(self.starts, len(data))}
        first = self.section_at[:-1][np.diff(self.section_at) > 0]
        self.root = np.full(docs, U64(0))
        self.root[np.diff(self.section_at) > 0] = self._fold(self.section, first)

    @staticmethod
    def _fold(children: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A hash for each run of children that starts at `first`, in order."""
        if not len(first):
            return np.zeros(0, dtype=U64)
        size = np.diff(np.append(first, len(children)))
        place = (np.arange(len(children)) - np.repeat(first, size)).astype(U64)
        return mix64(np.add.reduceat(mix64(children ^ mix64(place + _SALT)), first) + size.astype(U64))

    def fingerprints(self) -> list[str]:
        short = (self.leaf >> U64(40)).astype(np.uint32)
        signs = base64.urlsafe_b64encode(short.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()
        bounds = np.append(self.paragraph_first, len(self.leaf)).tolist()
        heads = (self.paragraph >> U64(32)).tolist()
        paragraphs = [f"{h:08x}={signs[4 * a : 4 * b]}" for h, a, b in zip(heads, bounds[:-1], bounds[1:])]
        bounds = np.append(self.section_first, len(paragraphs)).tolist()
        sections = [f"{h:08x}:{','.join(paragraphs[a:b])}" for h, a, b in zip((self.section >> U64(32)).tolist(), bounds[:-1], bounds[1:])]
        at = self.section_at.tolist()
        return [f"{r:016x}/{';'.join(sections[a:b])}" for r, a, b in zip(self.root.tolist(), at[:-1], at[1:])]

    def leaf_keys(self) -> np.ndarray:
        """24 bits of each leaf, as in the fingerprint."""
        return (self.leaf >> U64(40)).astype(np.int64)


def likeness(a: Forest, b: Forest, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """Share of common leaves of texts rows_a of a and rows_b of b, pair by pair, from what their fingerprints hold."""
    def keys(forest, rows):
        size = forest.leaf_at[rows + 1] - forest.leaf_at[rows]
        where = np.arange(size.sum()) + np.repeat(forest.leaf_at[rows] - (np.cumsum(size) - size), size)
        return size, np.unique((np.repeat(np.arange(len(rows)), size) << 24) | forest.leaf_keys()[where], return_counts=True)

    na, (ka, ca) = keys(a, rows_a)
    nb, (kb, cb) = keys(b, rows_b)
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.bincount(common >> 24, weights=np.minimum(ca[ia], cb[ib]), minlength=len(rows_a))
    same = a.root[rows_a] == b.root[rows_b]
    return np.where(same, 1.0, 2 * shared / np.maximum(na + nb, 1))


def _shared_leaves(a: Forest, i: int, b: Forest, j: int, back: bool) -> int:
    """Leaves that text i of a and text j of b share at the front (or back), by descent into the first (last) children that differ."""
    at = [(a.section_at[i], a.section_at[i + 1]), (b.section_at[j], b.section_at[j + 1])]
    for level in ("section", "paragraph", "leaf"):
        x, y = (getattr(t, level)[lo:hi][:: -1 if back else 1] for t, (lo, hi) in zip((a, b), at))
        n = min(len(x), len(y))
        other = (x[:n] != y[:n]).argmax() if n else 0
        k = int(other) if n and x[other] != y[other] else n
        edge = at[0][1] - k if back else at[0][0] + k
        if k == n or level == "leaf":  # one of them has no more children, or leaves differ
            for below in ("section", "paragraph")[("section", "paragraph", "leaf").index(level) :]:
                edge = a.bounds[below][edge]
            break
        at = [(t.bounds[level][m], t.bounds[level][m + 1]) for t, m in zip((a, b), (hi - k - 1 if back else lo + k for lo, hi in at))]
    return int(a.leaf_at[i + 1] - edge if back else edge - a.leaf_at[i])


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def edits(a: Forest, b: Forest, rows_a: np.ndarray, rows_b: np.ndarray) -> list[tuple[int, int, int] | None]:
    """(start, end, new end) pair by pair, in code points: text[start:end] of a became text[start:new end] of b, and all else is equal.

    The bounds are those of leaves; None where the roots agree.
    """
    out: list[tuple[int, int, int] | None] = []
    for i, j in zip(rows_a.tolist(), rows_b.tolist()):
        if a.root[i] == b.root[j]:
            out.append(None)
            continue
        n = [int(t.leaf_at[r + 1] - t.leaf_at[r]) for t, r in ((a, i), (b, j))]
        front = _shared_leaves(a, i, b, j, False)
        back = min(_shared_leaves(a, i, b, j, True), min(n) - front)
        ends, start = [], 0
        for t, r, size in ((a, i, n[0]), (b, j, n[1])):
            where = t.bounds["leaf"]
            lo, mid, hi = t.offsets[r], where[t.leaf_at[r] + front], where[t.leaf_at[r] + size - back]
            start = _characters(t.data[lo:mid])
            ends.append(start + _characters(t.data[mid:hi]))
        out.append((start, ends[0], ends[1]))
    return out


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, [(section, [(paragraph, [leaf])])]) of a fingerprint."""
    root, rest = fingerprint.split("/", 1)
    tree = []
    for section in rest.split(";") if rest else []:
        head, inner = section.split(":", 1)
        tree.append((head, [(p[:8], [p[k : k + 4] for k in range(9, len(p), 4)]) for p in inner.split(",")]))
    return root, tree


def likeness_of(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    (root_a, tree_a), (root_b, tree_b) = parse(a), parse(b)
    if root_a == root_b:
        return 1.0
    la, lb = (Counter(x for _, ps in t for _, ls in ps for x in ls) for t in (tree_a, tree_b))
    return 2 * (la & lb).total() / max(la.total() + lb.total(), 1)


def differing_branches(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of a whose paragraph doesn't occur in b; none when the roots agree."""
    (root_a, tree_a), (root_b, tree_b) = parse(a), parse(b)
    if root_a == root_b:
        return []
    sections = Counter(h for h, _ in tree_b)
    paragraphs = Counter(h for _, ps in tree_b for h, _ in ps)
    return [(i, j) for i, (h, ps) in enumerate(tree_a) if not sections[h] for j, (p, _) in enumerate(ps) if not paragraphs[p]]


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, edit_start, edit_end, edit_new_end) of every doc_id of both tables, in code points; nulls where texts are equal.

    A doc_id that one table lacks, or a null one, gives no row; repeated ones give a row for each pair.
    """

    def run(batches):
        for batch in pieces(batches):
            every = np.arange(batch.num_rows)
            found = edits(*(Forest(*buffers(batch.column(k))) for k in ("text", "edited")), every, every)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_edit_columns(found)], ["doc_id", *EDIT])

    both = before.select("doc_id", "text").join(after.select("doc_id", F.col("text").alias("edited")), "doc_id")
    return both.mapInArrow(run, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in EDIT))


EDIT = ("edit_start", "edit_end", "edit_new_end")


def _edit_columns(found) -> list[pa.Array]:
    return [pa.array([e and e[k] for e in found], pa.int64()) for k in range(3)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row of docs."""

    def run(batches):
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(Forest(*buffers(batch.column("text"))).fingerprints())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


#: Bytes of text in one run of neighbouring documents.
RUN_BYTES = 2 << 20


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """(run, last, k, h, doc_id, text): runs of documents in descending doc_id, each followed by the head of the next run (last = 1).

    Bounds are quantiles of doc_id, so one shuffle of the texts is enough; heads are
    one row a run.
    """
    low = -(2**63)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"))
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    runs = int(max(1, min(rows // 16, max((total or 0) // RUN_BYTES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 20000)))
    bounds = sorted({int(x) for x in keys.approxQuantile("k", [i / runs for i in range(1, runs)], 1 / (4 * runs))}) if runs > 1 else []
    spark = docs.sparkSession
    # number of bounds above k: a binary search in a constant array
    run_of = F.lit(0)
    if bounds:
        found = F.expr(f"array_size(filter(array({','.join(f'{b}L' for b in bounds)}), b -> b >= k))") if len(bounds) <= 8 else None
        if found is None:
            shared = spark.sparkContext.broadcast(np.array(bounds))

            @F.pandas_udf("int")
            def place(k):
                import pandas as pd

                return pd.Series((len(shared.value) - np.searchsorted(shared.value, k.to_numpy(), side="left")).astype(np.int32))

            run_of = place(F.col("k"))
        else:
            run_of = found
    rows_ = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("run", run_of.cast("int"))
    heads = {r.run: r.k for r in keys.withColumn("run", run_of.cast("int")).groupBy("run").agg(F.max("k").alias("k")).collect()}  # one row a run
    present = sorted(heads)
    before = {run: present[i - 1] for i, run in enumerate(present)}  # the run that this head follows; the first head follows the last run
    follow = spark.createDataFrame([(heads[run], before[run]) for run in present], "k long, run int") if present else spark.createDataFrame([], "k long, run int")
    head_rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(follow), "k")  # at most 20,000 rows of two numbers
    both = rows_.select("run", F.lit(0).alias("last"), "k", "doc_id", "text").unionByName(head_rows.select("run", F.lit(1).alias("last"), "k", "doc_id", "text"))
    both = both.withColumn("h", F.xxhash64("text"))
    return both.repartition(F.col("run")).sortWithinPartitions("run", "last", F.desc("k"), "h")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text, their likeness, and where their trees say that the edit lies.

    The edited text has the last third of its code points replaced by the first as
    many (or all) of the next document in descending doc_id; the first follows the
    last.  Documents of one doc_id are ordered by a hash of the text; null ids come last.
    """

    def run(batches):
        held: list[tuple] = []
        for batch in pieces(batches):
            rows = held + list(zip(*(batch.column(k).to_pylist() for k in ("run", "last", "doc_id", "text"))))
            if not rows:
                continue
            held = rows[-1:]
            use = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i + 1][0] == rows[i][0]]
            if not use:
                continue
            texts = [t or "" for _, _, _, t in rows]
            edited = []
            for i in use:
                k = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
            own, other = Forest(*buffers(pa.array(texts, pa.large_string()))), Forest(*buffers(pa.array(edited, pa.large_string())))
            prints, at = own.fingerprints(), np.array(use)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in use], pa.int64()), pa.array([len(texts[i]) for i in use], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([prints[i] for i in use]), pa.array(other.fingerprints()), pa.array(likeness(own, other, at, np.arange(len(use)))), pa.array(likeness(own, own, at, at + 1)),
                    *_edit_columns(edits(own, other, at, np.arange(len(use)))),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *EDIT],
            )

    return _with_neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_end long, edit_new_end long")
