"""Importance resampling towards a target distribution of hashed word runs.

The features of a text are its runs of one to three words, hashed into buckets.  A sparse
matrix of documents by buckets is persisted in CSR blocks (a table of rows: document ids,
row pointers, bucket numbers as gaps within a row, counts).  Its column sums are the
distribution of the corpus; those of the target texts, taken the same way, are the other
one.  A bucket's gain is the log ratio of both, and the product of the matrix with the gains
gives every document its weight.  Adding Gumbel noise from a hash of the id makes the
highest scores a draw without replacement in proportion to the weights.

Shape: texts are read once; blocks are as large as the documents that one Arrow piece holds;
the driver receives one number a bucket.  Scores are ranked by range partitions of narrow
rows, whose sizes give each its first rank, so no task sees them all.

Defined results: a null or empty text has no features and weight 0; a null doc_id is hashed
as an empty one and ranks after others of equal score; repeated rows are rows of their own,
drawn one by one; equal scores and ids are ordered by weight and features; an empty table
gives an empty result, and an empty target has no counts; very long texts are counted
whole; further columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WRITING, forget, pieces, settings, written
from .text import ALNUM, LOWER, buffers, words

BUCKETS, RUN = 10_000, 3
#: Longer words are hashed one by one.
STEPS = 64


def _remainders() -> np.ndarray:
    """CRC-32 of single bytes (reversed polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _remainders()


def _fed(crc: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 values carried on over a range of bytes each."""
    order = np.argsort(-length, kind="stable")
    state, start, length = ~crc[order], start[order], length[order]
    long = int(np.searchsorted(-length, -STEPS))
    for k in range(long):
        state[k] = ~np.uint32(zlib.crc32(data[start[k] : start[k] + length[k]].tobytes(), int(~state[k])))
    short = length[long:]
    for k in range(int(short[0]) if len(short) else 0):
        upto = long + int(np.searchsorted(-short, -k))
        part = state[long:upto]
        state[long:upto] = _CRC[(part ^ data[start[long:upto] + k]) & 0xFF] ^ (part >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, CRC-32) of every run of 1 to `run` words joined by a blank, and each document's words."""
    w = words(data, offsets, ALNUM, LOWER)
    data, length = LOWER[data], w.end - w.start
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(w.first[:-1], counts)
    at = np.arange(len(doc))
    crc = np.zeros(len(doc), dtype=np.uint32)
    docs, crcs = [], []
    for k in range(run):
        if k:
            more = place[at] + k < counts[doc[at]]
            at, state = at[more], ~crc[more]
            crc = ~(_CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> 8))
        crc = _fed(crc, data, w.start[at + k], length[at + k])
        docs.append(doc[at])
        crcs.append(crc)
    return np.concatenate(docs), np.concatenate(crcs), counts


def _split(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs (told by the first byte), byte plane by byte plane, which compresses well."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _joined(raw: bytes) -> np.ndarray:
    width = raw[0]
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}")[:, 0].astype(np.int64)


class Block:
    """Rows of the matrix in CSR form."""

    def __init__(self, pointers: np.ndarray, columns: np.ndarray, counts: np.ndarray):
        self.pointers, self.columns, self.counts = pointers, columns, counts

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, buckets: int, run: int) -> tuple[Block, np.ndarray]:
        """The counts of the texts of a buffer, and the words of each."""
        doc, crc, n_words = features(data, offsets, run)
        keys = np.sort(doc * buckets + crc % np.uint32(buckets))
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        distinct = keys[start]
        return cls(np.searchsorted(distinct, np.arange(len(offsets)) * buckets), distinct % buckets, np.diff(np.append(start, len(keys)))), n_words

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        gaps = np.diff(self.columns, prepend=0)
        first = self.pointers[:-1][self.pointers[1:] > self.pointers[:-1]]
        gaps[first] = self.columns[first]
        return _split(self.pointers), _split(gaps), _split(self.counts)

    @classmethod
    def read(cls, pointers: bytes, gaps: bytes, counts: bytes) -> Block:
        at = _joined(pointers)
        total = np.append(0, np.cumsum(_joined(gaps)))
        return cls(at, total[1:] - np.repeat(total[at[:-1]], np.diff(at)), _joined(counts))

    def rows(self, values: np.ndarray) -> np.ndarray:
        """Sums by row of one value an entry."""
        total = np.append(0, np.cumsum(values))
        return total[self.pointers[1:]] - total[self.pointers[:-1]]


def count_matrix(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """CSR blocks (ids, n_words, pointers, gaps, counts) of the documents' features by bucket, one block an Arrow piece."""

    def build(batches):
        for batch in pieces(batches):
            block, n_words = Block.of(*buffers(batch.column("text")), buckets, run)
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, batch.column("doc_id")), pa.ListArray.from_arrays(ends, pa.array(n_words.astype(np.int64))), *(pa.array([x], pa.binary()) for x in block.bytes())],
                ["ids", "n_words", "pointers", "gaps", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(build, f"ids array<{kind}>, n_words array<bigint>, pointers binary, gaps binary, counts binary")


def _blocks(batch: pa.RecordBatch):
    for row in zip(*(batch.column(c).to_pylist() for c in ("pointers", "gaps", "counts"))):
        yield Block.read(*row)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The count of every bucket: each partition adds up its blocks, and one number a bucket comes to the driver."""

    def add(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in _blocks(batch):
                total += np.bincount(b.columns, weights=b.counts, minlength=buckets).astype(np.int64)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    sums = matrix.select("pointers", "gaps", "counts").mapInArrow(add, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n"))
    with settings(matrix.sparkSession, WRITING):  # a block is about a megabyte: few to a batch
        for bucket, n in sums.collect():
            out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of every bucket, one added to each count."""
    buckets = len(source)
    s_all, t_all = float(int(source.sum()) + buckets), float(int(target.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def multiplied(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the product of the matrix with the gains."""

    def product(batches):
        for batch in batches:
            for k, b in enumerate(_blocks(batch)):
                columns = [batch.column(c).slice(k, 1).flatten() for c in ("ids", "n_words")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(b.rows(b.counts)), pa.array(b.rows(b.counts * gain[b.columns]))], ["doc_id", "n_words", "n_features", "weight"])

    kind = matrix.schema["ids"].dataType.elementType.simpleString()
    return matrix.mapInArrow(product, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def with_noise(weighted: DataFrame, seed: int = 42) -> DataFrame:
    """score: the weight and a thousand times Gumbel noise that a hash of the id decides."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def _numbered(batches):
    """Rows of a sorted partition with the partition and the place in it."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = np.arange(seen + 1, seen + batch.num_rows + 1)
        seen += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(places)], [*batch.schema.names, "part", "place"])


def drawn(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """scored with rank: 1, 2, 3 ... of the floor(percent N / 100) highest scores among the N documents of least_words words or more; null for others."""
    spark: SparkSession = scored.sparkSession
    fit = scored.withColumn("fit", F.col("n_words") >= least_words).withColumn("copy", F.monotonically_increasing_id())
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("copy")]
    ranges = fit.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    ranked = written(ranges.mapInArrow(_numbered, f"{fields}, part int, place bigint"), "ranked")
    sizes = sorted(ranked.groupBy("part").agg(F.count("*"), F.count_if("fit")).collect())
    before, rows, n = [], 0, 0
    for part, size, fits in sizes:
        before.append((part, rows))
        rows, n = rows + size, n + fits
    firsts = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))  # a row a partition
    rank = F.col("place") + F.col("before")
    return ranked.join(firsts, "part").withColumn("rank", F.when(F.col("fit") & (rank <= percent * n // 100), rank)).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; target has texts of the wanted distribution."""
    matrix = written(count_matrix(docs, buckets, run), "matrix")
    wanted = column_sums(count_matrix(target.select(F.lit(None).cast("int").alias("doc_id"), "text"), buckets, run), buckets)
    out = drawn(with_noise(multiplied(matrix, gains(column_sums(matrix, buckets), wanted)), seed), percent, least_words)
    forget(matrix)
    return out
