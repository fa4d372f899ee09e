"""Data sources on a mounted file system: ranges, packing, pushed filters, sinks that lose nothing."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.sources import datasource as D
from echoframe.sources import recordings as S
from echoframe.sources.guano import guano_chunk
from echoframe.sources.wav import layout, read_wav, samples, write_wav
from echoframe.sources.zc import read_zc
from tests.test_sources import wac, wave, zc


@pytest.fixture(scope="module")
def sources(spark):
    D.register(spark)
    return spark


class Counted(io.FileIO):
    """A file that counts what is read from it."""

    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_an_hour_is_many_pieces_and_a_second_little(tmp_path):
    head = write_wav(np.zeros(0, np.int16), 48000)
    with (tmp_path / "hour.wav").open("wb") as f:  # a sparse file
        f.write(head[:-4] + (2 * 3600 * 48000).to_bytes(4, "little"))
        f.truncate(len(head) + 2 * 3600 * 48000)
    reader = D.SampleReader({"path": str(tmp_path / "*.wav")})
    pieces = [p for part in reader.partitions() for p in part.pieces]
    assert len(reader.partitions()) >= 16 and sum(p.last - p.first for p in pieces) == 3600 * 48000
    assert sorted((p.first, p.last) for p in pieces)[1][0] % reader.block == 0
    second = D.SampleReader({"path": str(tmp_path / "*.wav"), "start": "1800", "stop": "1801"})
    assert sum(p.last - p.first for part in second.partitions() for p in part.pieces) == 48000
    with Counted(tmp_path / "hour.wav") as f:
        where = layout(f)
        left, _ = samples(f, where, *where.span(1800, 1801))
        assert len(left) == 48000 and f.taken < 2e6


def test_ranges_hold_what_reading_whole_gives(sources, tmp_path):
    rng = np.random.default_rng(1)
    for name, bits, channels in (("a", 16, 1), ("b", 24, 2), ("c", 8, 2), ("d", 32, 1)):
        x = rng.integers(-100, 100, (channels, 10_000))
        (tmp_path / f"{name}.wav").write_bytes(write_wav(x[0], 1000, x[1] if channels > 1 else None, bits, extra=[(b"junk", b"odd")]))
    read = lambda **o: sources.read.format("samples").options(block=512, partition_bytes=4000, **o).load(str(tmp_path / "*.wav"))
    for options, span in (({}, (None, None)), (dict(start=2.5, stop=7.25), (2.5, 7.25)), (dict(start=9.999), (9.999, None)), (dict(start=20), (20, None))):
        got = read(**options)
        for name in "abcd":
            want = read_wav((tmp_path / f"{name}.wav").read_bytes(), *span)
            rows = sorted(got.filter(F.col("filename") == f"{name}.wav").collect(), key=lambda r: r.sample_offset)
            assert [v for r in rows for v in r.left] == want["left"].tolist()
            assert [v for r in rows for v in r.right] == ([] if want["right"] is None else want["right"].tolist())
            assert all(r.n_samples == len(r.left) and r.sample_offset % 512 in (0, 2500 % 512, 9999 % 512) for r in rows)
    assert read().rdd.getNumPartitions() > 16
    filtered = read().filter("filename = 'a.wav' and sample_offset >= 2000 and sample_offset < 3000")
    assert sorted(r.sample_offset for r in filtered.collect()) == [2048, 2560]


def test_filters_on_offsets_leave_blocks_unplanned(tmp_path):
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    (tmp_path / "a.wav").write_bytes(write_wav(np.arange(10_000), 1000))
    reader = D.SampleReader({"path": str(tmp_path / "*.wav"), "block": "100"})
    kept = list(reader.pushFilters([GreaterThan(("sample_offset",), 4000), LessThanOrEqual(("sample_offset",), 4300)]))
    assert len(kept) == 2
    assert [(p.first, p.last) for part in reader.partitions() for p in part.pieces] == [(4000, 4400)]


def test_small_files_are_packed(tmp_path):
    rng = np.random.default_rng(2)
    pieces = [D.Piece(f"{k}", int(n)) for k, n in enumerate(rng.integers(1000, 200_000, 10_000))]
    parts = D.packed(pieces, 32, 1 << 40)
    held = [sum(p.bytes for p in part.pieces) for part in parts]
    assert len(parts) <= 32 and max(held) <= 2 * np.mean(held) and sum(len(p.pieces) for p in parts) == 10_000
    assert D.packed([], 8) == [] and len(D.packed(pieces[:3], 8)) == 3
    for k in range(100):
        (tmp_path / f"{k}.wav").write_bytes(write_wav([k], 8000))
    assert len(D.SampleReader({"path": str(tmp_path / "*.wav"), "partitions": "6"}).partitions()) == 6


def test_whole_recordings(sources, tmp_path):
    (tmp_path / "a.wav").write_bytes(write_wav(np.arange(100), 8000, extra=[guano_chunk({"TE": "10"})]))
    (tmp_path / "b_20200102_030405.wac").write_bytes(wac([None, [wave(1, 256)], None, [wave(2, 256)]], flags=0x10))
    (tmp_path / "bad.wav").write_bytes(b"never opened")
    read = sources.read.format("recordings").option("start", 0.001).load(f"{tmp_path}/*")
    [r] = read.filter("filename = 'a.wav'").collect()
    assert (r.left, r.guano, r.n_samples, r.right) == (list(range(8, 100)), {"TE": "10"}, 92, [])
    same = S.read_audio(sources, f"{tmp_path}/a.wav", start=0.001).first()
    assert {k: v for k, v in r.asDict().items() if k not in ("path", "recording_id")} == {k: v for k, v in same.asDict().items() if k not in ("path", "recording_id")}
    segments = sources.read.format("recordings").load(f"{tmp_path}/*.wac").collect()
    assert sorted((r.filename, r.n_samples, r.recorded_at) for r in segments) == [("b_20200102_030405_005.wav", 256, "20200102_030405_005"), ("b_20200102_030405_016.wav", 256, "20200102_030405_016")]


def rows(n, name="x.wav"):
    return [(f"/d{k}/{name}#0", name, 8000, 2, 16, list(range(k, k + 5)), [-v for v in range(5)]) for k in range(n)]


def wav(spark, data, folder, mode="append"):
    spark.createDataFrame(data, D.WAV_ROW).repartition(3).write.format("wav").mode(mode).save(str(folder))


def test_rows_of_one_file_name_are_all_kept(sources, tmp_path):
    wav(sources, rows(3), tmp_path / "out")
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and all(p.suffix == ".wav" for p in files)
    assert sorted(read_wav(p.read_bytes())["left"][0] for p in files) == [0, 1, 2]
    wav(sources, rows(3), tmp_path / "out")  # the same job again
    assert sorted((tmp_path / "out").iterdir()) == files


def test_segments_of_a_triggered_file(sources, tmp_path):
    (tmp_path / "b_20200102_030405.wac").write_bytes(wac([None, [wave(1, 256)], None, [wave(2, 256)]], flags=0x10))
    (tmp_path / "odd name.wac").write_bytes(wac([None, [wave(1, 256)], None, [wave(2, 256)]], flags=0x10))
    S.read_audio(sources, str(tmp_path / "*.wac")).write.format("wav").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b_20200102_030405_005.wav", "b_20200102_030405_016.wav", "odd name_0.wav", "odd name_1.wav"]


def test_what_would_be_lost_is_an_error(sources, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(Exception, match="same recording"):
        wav(sources, rows(1) * 2, out)
    assert not out.exists() or not list(out.iterdir())
    wav(sources, rows(1), out)
    with pytest.raises(Exception, match="other content"):
        wav(sources, [(*rows(1)[0][:5], [9] * 5, [9] * 5)], out)
    assert [p.name for p in out.iterdir()] == ["x.wav"] and read_wav((out / "x.wav").read_bytes())["left"].tolist() == list(range(5))


def test_overwrite_replaces_the_files_of_its_format(sources, tmp_path):
    out = tmp_path / "out"
    wav(sources, rows(2), out)
    (out / "notes.txt").write_text("stays")
    wav(sources, rows(1, "y.wac"), out, "overwrite")
    assert sorted(p.name for p in out.iterdir()) == ["notes.txt", "y.wav"]


def test_a_failed_job_leaves_nothing(sources, tmp_path):
    out = tmp_path / "out"
    wav(sources, rows(1, "kept.wav"), out)
    bad = [*rows(4), ("z", "z.wav", 8000, 1, 12, [1], [])]  # 12 bits can't be written
    with pytest.raises(Exception):
        wav(sources, bad, out, "overwrite")
    assert [p.name for p in out.iterdir()] == ["kept.wav"]


def test_thousands_of_rows_are_as_many_files(sources, tmp_path):
    d = sources.range(5000).select(F.concat(F.lit("r"), F.col("id") % 50, F.lit("#"), F.col("id")).alias("recording_id"), F.concat(F.lit("r"), F.col("id") % 50, F.lit(".wac")).alias("filename"), F.lit(8000).alias("sample_rate"),
                                    F.lit(1).alias("channels"), F.lit(16).alias("bit_depth"), F.array(F.col("id").cast("int") % 1000).alias("left"), F.array().cast("array<int>").alias("right"))
    d.write.format("wav").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.wav"))) == 5000 == len(list((tmp_path / "out").iterdir()))


def test_zero_crossing_files(sources, tmp_path):
    raw = zc(131, bytes([1, 2]))
    d = sources.createDataFrame([("a.zc", bytearray(raw), {"SPECIES": "Nyctalus"}), ("b.18#", bytearray(raw), {"SPECIES": "Myotis"}), ("c.dat", bytearray(raw), {})], D.ZC_ROW)
    d.write.format("zero_crossing").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.zc", "b.18#", "c.zc"]
    assert read_zc((tmp_path / "out/a.zc").read_bytes())["metadata"]["SPECIES"] == "Nyctalus"
    with pytest.raises(Exception, match="same recording"):
        d.limit(1).union(d.limit(1)).write.format("zero_crossing").mode("append").save(str(tmp_path / "two"))
