"""Token-ID output: documents' ids in zstandard frames with one shared dictionary.

The format is a table of containers (Parquet, so that Spark writes it to any store):

    part, seq   containers in document order: by part, then seq
    before      ids of all documents before the container within its part
    dict_hash   SHA-256 of the dictionary
    blob        "EFTK", version, bytes per id, documents; the index (doc_id or the
                null mark, ids, offset of the frame, of each document); the frames

Each document is a frame of its own, so a short one is read without its neighbours:
find its index entry, decompress that frame.  Beside it, the dictionary is a table
with one row.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import Encoder
from .shared import WRITING, pieces, settings, shared_folder
from .text import buffers

MAGIC, VERSION = b"EFTK", 1
_HEAD = struct.Struct("<4sHHI")
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("offset", "<u8")])
CONTAINER_BYTES = 4 << 20
#: Bounds of the sample on which the dictionary is trained: documents, and bytes of ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 8 << 20, 64 << 10
LEVEL = 3

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """This process's encoder for a file of public_tokenizers or a path."""
    import os

    import public_tokenizers

    path = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
    return _encoders.setdefault((path, ""), _encoders.get((path, "")) or Encoder(path))


def id_arrays(batch: pa.RecordBatch, tokenizer: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text with the end id."""
    rows = encoder(tokenizer).encode(*buffers(batch.column("text")))
    end = np.array([end_id], dtype=np.int32)
    return [np.concatenate([rows.flat[a:b], end]) for a, b in zip(rows.at[:-1], rows.at[1:])]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary from the first SAMPLE_DOCS documents by a hash of doc_id and text."""
    def run(batches):
        for batch in pieces(batches):
            ids = id_arrays(batch, tokenizer, end_id)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(f"<u{width}").tobytes()[: SAMPLE_BYTES // 64] for x in ids], pa.binary())], ["ids"])

    # hashes are even: about twice the sample lies below this bound, however many documents there are
    share = min(1.0, 2 * SAMPLE_DOCS / max(docs.count(), 1))
    keys = docs.select("doc_id", "text").withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))).filter(F.col("h") <= int(share * (1 << 31)))
    sample = keys.orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id", "text").mapInArrow(run, "ids binary")
    parts, total = [], 0
    for row in sample.toLocalIterator():
        parts.append(bytes(row.ids))
        total += len(parts[-1])
        if total > SAMPLE_BYTES:
            break
    parts.sort()
    if total > 20 * DICT_BYTES // 8 and len(parts) > 50:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, total // 10), parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too uniform a sample; its bytes serve as they are
    return b"".join(parts)[-DICT_BYTES:] or b"\0" * 8


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)


def pack(entries: list[tuple[int | None, int, bytes]], width: int) -> bytes:
    """A container from (doc_id, number of ids, frame)."""
    index = np.zeros(len(entries), dtype=_INDEX)
    index["doc_id"] = [i or 0 for i, _, _ in entries]
    index["null"] = [i is None for i, _, _ in entries]
    index["ids"] = [n for _, n, _ in entries]
    index["offset"] = np.cumsum([0, *(len(f) for _, _, f in entries[:-1])])
    return _HEAD.pack(MAGIC, VERSION, width, len(entries)) + index.tobytes() + b"".join(f for _, _, f in entries)


def unpack(blob: bytes):
    """(bytes per id, index, frames as one buffer) of a container."""
    magic, version, width, n = _HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token container")
    at = _HEAD.size + n * _INDEX.itemsize
    return width, np.frombuffer(blob, dtype=_INDEX, count=n, offset=_HEAD.size), memoryview(blob)[at:]


def read_document(blob: bytes, number: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document of a container, without touching the others."""
    width, index, frames = unpack(blob)
    a = int(index["offset"][number])
    b = int(index["offset"][number + 1]) if number + 1 < len(index) else len(frames)
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(bytes(frames[a:b]))
    return np.frombuffer(raw, dtype=f"<u{width}")


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: two where all ids of the tokenizer and the end id fit, else four."""
    most = max(max(encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values(), default=0), end_id)
    return 2 if most < 1 << 16 else 4


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode docs and write them under path (containers/, dictionary/) in ascending doc_id order.

    Null ids come last, equal ids in the order of a hash of their texts; a null text
    is an empty one and has the end id alone; an empty table gives files without
    documents; repeated rows are written each; a very long text is one frame.  doc_id is
    an integer column, and further columns are not read.
    """
    width = id_bytes(tokenizer, end_id)
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "dict_hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)

    def run(batches):
        part = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True)
        seq = before = count = size = 0
        held: list = []

        def container():
            nonlocal seq, before, count, size, held
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([digest]), pa.array([pack(held, width)], pa.binary())], ["part", "seq", "before", "dict_hash", "blob"])
            seq, before, count, size, held = seq + 1, before + count, 0, 0, []
            return row

        for batch in pieces(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), id_arrays(batch, tokenizer, end_id)):
                frame = press.compress(ids.astype(f"<u{width}").tobytes())
                held.append((doc_id, len(ids), frame))
                count, size = count + len(ids), size + len(frame)
                if size > CONTAINER_BYTES:
                    yield container()
        if held:
            yield container()

    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with settings(spark, WRITING):
        ordered.mapInArrow(run, "part int, seq int, before long, dict_hash string, blob binary").write.option("compression", "none").parquet(f"{path}/containers")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ids_crc32 is of 32-bit little-endian ids."""
    containers = spark.read.schema("part int, seq int, before long, dict_hash string, blob binary").parquet(f"{path}/containers")
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])
    digest = hashlib.sha256(raw).hexdigest()
    # ids in each part: from the last container's count before it and its index; one row a part
    def totals(batches):
        for batch in batches:
            counts = [int(unpack(b)[1]["ids"].sum()) for b in batch.column("blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(counts, pa.int64())], ["part", "ids"])

    sums = {r.part: r.ids for r in containers.select("part", "blob").mapInArrow(totals, "part int, ids long").groupBy("part").agg(F.sum("ids").alias("ids")).collect()}
    offset, total = {}, 0
    for part in sorted(sums):
        offset[part] = total
        total += sums[part]
    shared = spark.sparkContext.broadcast((raw, offset))

    def run(batches):
        raw, offset = shared.value
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for part, before, found, blob in zip(*(batch.column(k).to_pylist() for k in ("part", "before", "dict_hash", "blob"))):
                if found != digest:
                    raise ValueError("a container was written with another dictionary")
                width, index, frames = unpack(blob)
                bounds = [*index["offset"].tolist(), len(frames)]
                crc, n = [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    ids = np.frombuffer(open_.decompress(frames[a:b]), dtype=f"<u{width}")
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                start = offset[part] + before + np.cumsum([0, *n[:-1]])
                ids_of = pa.array(index["doc_id"].astype(np.int64), mask=index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(start.astype(np.int64)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return containers.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
