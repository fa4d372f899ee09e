"""Data sources on a file system that all executors mount: spark.read.format("recordings" | "samples"), df.write.format("wav" | "zero_crossing" | "event_report").

`recordings` gives a row a recording, `samples` a row a block of a WAV file's samples, so
that one long file is read by many tasks.  Both plan partitions by bytes: files are cut
into pieces of PARTITION_BYTES at most (`samples` only) and small ones are packed together.
`start` and `stop` (seconds) become byte ranges, so other samples are neither read nor
planned; filters on path, filename and (of `samples`) sample_offset are pushed down.  Rows
come as Arrow batches.  Files of object stores are read with recordings.read_audio.

The sinks write a file a row into a folder beside the last place and move them when the job
commits.  A name is that of the row with the format's extension; rows of different
recordings with one name get a mark of their recording_id, and equal recordings are an
error, as is a file that is already there with other content (mode append).  Mode overwrite
removes the format's other files when the job commits.  A job that fails leaves nothing.
"""

from __future__ import annotations

import filecmp
import glob
import hashlib
import heapq
import json
import os
import re
import shutil
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from .guano import guano_text, parse_guano
from .recordings import RECORDING, decode
from .report import index_page
from .wav import layout, samples, write_wav
from .zc import write_zc

SAMPLES = "recording_id string, path string, filename string, sample_rate int, bit_depth int, channels int, sample_offset bigint, n_samples int, left array<int>, right array<int>"
WAV_ROW = "recording_id string, filename string, sample_rate int, channels int, bit_depth int, left array<int>, right array<int>"
REPORT_ROW = "recording_id string, event_start bigint, cells array<string>, picture binary"
ZC_ROW = "filename string, content binary, metadata map<string,string>"
#: Bytes of a partition at most, what opening a file counts as, and samples of a row of `samples`.
PARTITION_BYTES, OPEN_BYTES, BLOCK = 8 << 20, 64 << 10, 1 << 16


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _local(path: str) -> str:
    return path.removeprefix("file:")


@dataclass(frozen=True)
class Piece:
    """Samples first to last (exclusive) of a file, or all of it."""

    path: str
    bytes: int
    first: int | None = None
    last: int | None = None


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece] = field(default_factory=list)


def packed(pieces: list[Piece], partitions: int, most: int = PARTITION_BYTES) -> list[Pieces]:
    """Pieces dealt to partitions of about `most` bytes, or to `partitions` where there are fewer bytes: the largest first, each to the partition with the least so far."""
    size = lambda p: p.bytes + OPEN_BYTES
    n = max(1, min(len(pieces), max(partitions, -(-sum(map(size, pieces)) // most))))
    heap = [(0, k) for k in range(n)]
    out = [Pieces() for _ in range(n)]
    for p in sorted(pieces, key=lambda p: (-p.bytes, p.path, p.first or 0)):
        held, k = heapq.heappop(heap)
        out[k].pieces.append(p)
        heapq.heappush(heap, (held + size(p), k))
    return [p for p in out if p.pieces]


class FileReader(DataSourceReader):
    """What both readers share: options, pushed filters on names, packing."""

    def __init__(self, options: dict):
        # a list of paths comes as a glob or separated by commas
        self.files = sorted({f for p in options["path"].split(",") for f in glob.glob(_local(p))})
        self.time_exp = float(options.get("time_exp", 1))
        self.start, self.stop = (None if options.get(k) is None else float(options[k]) for k in ("start", "stop"))
        if self.start is not None and self.stop is not None and self.start > self.stop:
            raise ValueError("start must not be after stop")
        self.most, self.block = int(options.get("partition_bytes", PARTITION_BYTES)), int(options.get("block", BLOCK))
        self.at_least = int(options.get("partitions", 4 * (os.cpu_count() or 1)))
        self.low, self.high = 0, None  # of sample_offset, high exclusive

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on path and filename; those on sample_offset leave out blocks and stay Spark's, like all others."""
        tests = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x)}
        for f in filters:
            column, test = getattr(f, "attribute", None), tests.get(type(f))
            if column in (("path",), ("filename",)) and test is not None:
                value = os.path.basename if column == ("filename",) else str
                self.files = [p for p in self.files if test(value(p), f.value)]
                continue
            if column == ("sample_offset",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f


class RecordingReader(FileReader):
    """A row a recording; of WAV files only the asked range is read."""

    def partitions(self) -> list[Pieces]:
        return packed([Piece(p, os.path.getsize(p)) for p in self.files], self.at_least, self.most)

    def read(self, partition: Pieces):
        kind = _arrow(RECORDING)
        for piece in partition.pieces:
            with open(piece.path, "rb", buffering=0) as f:
                if piece.path.lower().endswith(".wav"):
                    where = layout(f)
                    left, right = samples(f, where, *where.span(self.start, self.stop, self.time_exp))
                    name = os.path.basename(piece.path)
                    found = [dict(
                        recording_id=f"{piece.path}#0", path=piece.path, filename=name, format="wav", sample_rate=int(where.rate * self.time_exp), bit_depth=where.bits, channels=where.channels, time_exp=self.time_exp,
                        n_samples=len(left), segment_idx=0, trigger_sample=0, recorded_at=None, left=left, right=np.zeros(0, np.int32) if right is None else right, guano=parse_guano(guano_text(f)),
                    )]
                else:
                    found = decode(piece.path, f.read(), self.time_exp, self.start, self.stop)
            for row in found:
                row["guano"] = list(row["guano"].items())
                yield pa.RecordBatch.from_arrays([pa.array([row[c.name]], c.type) for c in kind], schema=kind)


class SampleReader(FileReader):
    """Blocks of samples of WAV files: a block of k samples starts at a multiple of k, but for the first and last one of a range."""

    def span(self, where) -> tuple[int, int]:
        """The samples of a file that the range and the pushed filters leave, in whole blocks of the range."""
        a, b = where.span(self.start, self.stop, self.time_exp)
        if self.high is not None:  # the last block that starts before it
            b = min(b, -(-max(self.high, 0) // self.block) * self.block)
        return max(a, self.low // self.block * self.block), b

    def partitions(self) -> list[Pieces]:
        """Only files of several pieces, and those of a range, are opened to plan; the others are left to their tasks whole."""
        pieces = []
        ranged = self.start is not None or self.stop is not None or self.low or self.high is not None
        for path in self.files:
            size = os.path.getsize(path)
            if not ranged and size <= self.most:
                pieces.append(Piece(path, size))
                continue
            with open(path, "rb", buffering=0) as f:
                where = layout(f)
            a, b = self.span(where)
            step = max(1, self.most // (where.width * self.block)) * self.block
            for k in range(a // step * step, b, step):
                first, last = max(k, a), min(k + step, b)
                pieces.append(Piece(path, (last - first) * where.width, first, last))
        return packed(pieces, self.at_least, self.most)

    def read(self, partition: Pieces):
        kind = _arrow(SAMPLES)
        for piece in partition.pieces:
            with open(piece.path, "rb", buffering=0) as f:
                where = layout(f)
                at, last = self.span(where) if piece.first is None else (piece.first, piece.last)
                while at < last:
                    to = min(at // self.block * self.block + self.block, last)
                    left, right = samples(f, where, at, to)
                    row = (f"{piece.path}#0", piece.path, os.path.basename(piece.path), int(where.rate * self.time_exp), where.bits, where.channels, at, to - at, left, np.zeros(0, np.int32) if right is None else right)
                    yield pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(row, kind)], schema=kind)
                    at = to


class Recordings(DataSource):
    """Recordings of WAV and WAC files."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return RECORDING

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)


class Samples(DataSource):
    """Blocks of samples of WAV files."""

    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(self.options)


@dataclass
class _Written(WriterCommitMessage):
    #: (staged file, its name, its recording)
    files: list[tuple[str, str, str]]


class FileWriter(DataSourceWriter):
    """One file a row: staged by the tasks, named and moved by the commit."""

    def __init__(self, folder: str, ending: str, own: str, content, overwrite: bool):
        """own: a pattern of the file names that are of this format as they are."""
        self.folder, self.ending, self.own, self.content, self.overwrite = _local(folder), ending, own, content, overwrite
        self.staging = os.path.join(self.folder, f"_writing-{uuid.uuid4().hex}")

    def named(self, filename: str) -> str:
        """The name with the format's extension."""
        name = os.path.basename(filename)
        return name if re.search(self.own, name.lower()) else os.path.splitext(name)[0] + self.ending

    def write(self, rows) -> _Written:
        os.makedirs(self.staging, exist_ok=True)
        files = []
        for r in rows:
            now = os.path.join(self.staging, uuid.uuid4().hex)
            with open(now, "wb") as f:
                f.write(self.content(r))
            files.append((now, self.named(r.filename), r.recording_id if "recording_id" in r.__fields__ else ""))
        return _Written(files)

    def commit(self, messages) -> None:
        """Gives each file its name and moves it there."""
        try:
            by_name = defaultdict(list)
            for m in messages:
                for now, name, recording in m.files if m else ():
                    by_name[name].append((now, recording))
            moves = {}
            for name, files in by_name.items():
                if len({recording for _, recording in files}) < len(files):
                    raise ValueError(f"several rows of the same recording would be written to {name}")
                stem, ending = os.path.splitext(name)
                for now, recording in files:
                    moves[name if len(files) == 1 else f"{stem}_{hashlib.sha256(recording.encode()).hexdigest()[:12]}{ending}"] = now
            there = {} if self.overwrite else {name: os.path.join(self.folder, name) for name in moves if os.path.exists(os.path.join(self.folder, name))}
            if other := sorted(name for name, path in there.items() if not filecmp.cmp(path, moves[name], shallow=False)):
                raise FileExistsError(f"{other[0]} and {len(other) - 1} more files are there with other content; mode overwrite replaces them")
            for name, now in moves.items():
                os.replace(now, os.path.join(self.folder, name))
            if self.overwrite:
                for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
                    if re.search(self.own, name.lower()) and name not in moves:
                        os.remove(os.path.join(self.folder, name))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class WavFiles(DataSource):
    """A WAV file for each row of WAV_ROW; rates above 44,100 Hz get an extensible header."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return WAV_ROW

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], ".wav", r"\.wav$", lambda r: write_wav(r.left, r.sample_rate, r.right if r.channels > 1 else None, r.bit_depth), overwrite)


class ZeroCrossingFiles(DataSource):
    """A zero-crossing file for each row of ZC_ROW (and recording_id, if there): its content with the header texts of its metadata."""

    @classmethod
    def name(cls) -> str:
        return "zero_crossing"

    def schema(self) -> str:
        return ZC_ROW

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], ".zc", r"(zc|[0-9]{2}#)$", lambda r: write_zc(bytes(r.content), dict(r.metadata)), overwrite)


class ReportWriter(DataSourceWriter):
    """Tasks write pictures and a sorted part of the index each; the commit merges the parts, line by line, and moves the pictures."""

    def __init__(self, folder: str, columns: list[str], overwrite: bool):
        self.folder, self.columns, self.overwrite = _local(folder), columns, overwrite
        self.staging = os.path.join(self.folder, f"_writing-{uuid.uuid4().hex}")

    def write(self, rows) -> _Written:
        os.makedirs(self.staging, exist_ok=True)
        part, lines = os.path.join(self.staging, uuid.uuid4().hex), []
        for r in rows:
            name = f"{hashlib.sha256(r.recording_id.encode()).hexdigest()[:12]}_{r.event_start}.png"
            with open(f"{part}-{name}", "wb") as f:
                f.write(bytes(r.picture))
            lines.append((r.recording_id, r.event_start, name, list(r.cells)))
        with open(part, "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in sorted(lines))
        return _Written([(part, "", "")])

    def commit(self, messages) -> None:
        parts = [part for m in messages if m for part, _, _ in m.files]

        def lines(part: str):
            with open(part) as f:
                for line in f:
                    yield (*json.loads(line), part)

        def entries():
            last = None
            for recording, start, name, cells, part in heapq.merge(*map(lines, parts)):
                if name == last:
                    raise ValueError(f"two events of {recording} start at {start}")
                last = name
                names.add(name)
                os.replace(f"{part}-{name}", os.path.join(moved, name))
                yield recording, name, cells

        names: set[str] = set()
        moved = os.path.join(self.staging, "done")
        try:
            if not self.overwrite and os.path.exists(os.path.join(self.folder, "index.html")):
                raise FileExistsError("there is a report already; mode overwrite replaces it")
            os.makedirs(moved, exist_ok=True)
            with open(os.path.join(moved, "index.html"), "w") as f:
                f.writelines(x + "\n" for x in index_page(self.columns, entries()))
            for name in os.listdir(self.folder):  # an earlier report's pictures
                if re.fullmatch(r"[0-9a-f]{12}_\d+\.png", name) and name not in names:
                    os.remove(os.path.join(self.folder, name))
            for name in [*names, "index.html"]:
                os.replace(os.path.join(moved, name), os.path.join(self.folder, name))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class EventReports(DataSource):
    """A report of the rows of REPORT_ROW; option columns: a JSON list of the names of cells."""

    @classmethod
    def name(cls) -> str:
        return "event_report"

    def schema(self) -> str:
        return REPORT_ROW

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options["path"], json.loads(self.options.get("columns", "[]")), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the five formats known to the session and turns on filter pushdown for Python sources, without which Spark refuses readers that take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Recordings, Samples, WavFiles, ZeroCrossingFiles, EventReports):
        spark.dataSource.register(source)
