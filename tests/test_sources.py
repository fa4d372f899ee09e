"""Codecs: round trips with own encoders, and reading through Spark."""

import struct

import numpy as np
import pytest

from echoframe.sources import recordings as S
from echoframe.sources.guano import guano_chunk, guano_text, parse_guano
from echoframe.sources.wac import read_wac
from echoframe.sources.wav import read_wav, write_wav
from echoframe.sources.zc import FIELDS, read_zc, write_zc


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("rate", [8000, 96000])
def test_wav_round_trip(bits, rate):
    rng = np.random.default_rng(bits)
    top = 2 ** (min(bits, 31) - 1) - 1
    left, right = rng.integers(-top, top, 1001), rng.integers(-top, top, 1001)
    w = read_wav(write_wav(left, rate, right, bits))
    assert (w["sample_rate"], w["bit_depth"], w["channels"]) == (rate, bits, 2)
    assert (w["left"] == left).all() and (w["right"] == right).all()


def test_wav_slices_and_time_expansion():
    w = read_wav(write_wav(np.arange(1000), 100), 1, 3, 2)
    assert w["sample_rate"] == 200 and w["left"].tolist() == list(range(200, 600))
    with pytest.raises(ValueError):
        read_wav(b"junk")


def test_guano():
    md = {"GUANO|Version": "1.0", "TE": "", "Note": "a\nb: c", "Loc Position": "12.5 -3.25", "Samplerate": "96000", "Timestamp": "2020-01-02T03:04:05.678Z"}
    raw = write_wav([1, 2, 3], 8000, extra=[(b"junk", b"odd"), guano_chunk(md)])
    got = parse_guano(guano_text(raw))
    assert got["TE"] == "1" and got["Note"] == "a\nb: c" and got["Loc Position Lat"] == "12.5" and got["Loc Position Lon"] == "-3.25"
    assert parse_guano(None) == {} and parse_guano("no colon\n: x\n") == {}


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def word(self, value):
        while len(self.bits) % 16:
            self.bits.append(0)
        self.put(value, 16)

    def raw(self):
        while len(self.bits) % 16:
            self.bits.append(0)
        words = [int("".join(map(str, self.bits[k : k + 16])), 2) for k in range(0, len(self.bits), 16)]
        return struct.pack(f"<{len(words)}H", *words)


def wac(frames, channels=1, flags=0, block=4, g=5, rate=48000):
    """frames: list of lists of channel samples (None: a zero frame)."""
    size, w = 256 // channels, Writer()
    for number, frame in enumerate(frames):
        if number % block == 0:
            index = number // block
            for v in (0x8000, 1, index & 0xFFFF, index >> 16):
                w.word(v)
            if flags & 0x20 and index % 2 == 0:
                w.put(123, 25)
                w.put(456, 26)
            if flags & 0x40:
                w.put(3, 4)
        for _ in range(channels):
            w.put(0 if frame is None else g, 4)
        if frame is None:
            continue
        last = [0] * channels
        for k in range(size):
            for c in range(channels):
                d = (frame[c][k] >> (flags & 15)) - last[c]
                last[c] += d
                code = 2 * d if d >= 0 else -2 * d - 1
                w.put(code & ((1 << g) - 1), g)
                quotient, bit = code >> g, code & 1
                for _ in range(quotient):
                    w.put(bit, 1)
                    bit ^= 1
                w.put(bit ^ 1, 1)
    head = b"WAac" + bytes([4, channels]) + struct.pack("<HHH", size, block, flags) + struct.pack("<IIHH", rate, len(frames) * size, 2, 1)
    return head + struct.pack("<H", 13) + w.raw()


def wave(seed, n):
    return (np.cumsum(np.random.default_rng(seed).integers(-40, 40, n))).tolist()


@pytest.mark.parametrize("channels,flags", [(1, 0), (2, 0), (1, 0x60), (2, 0x20), (1, 2)])
def test_wac_round_trip(channels, flags):
    size = 256 // channels
    frames = [[wave(10 * k + c, size) for c in range(channels)] for k in range(9)]
    got = read_wac(wac(frames, channels, flags))
    assert len(got["segments"]) == 1
    shift = flags & 15
    for c in range(channels):
        assert got["segments"][0][1 + c].tolist() == [v >> shift << shift for f in frames for v in f[c]]


def test_wac_triggers_and_errors():
    frames = [None, [wave(1, 256)], [wave(2, 256)], None, None, [wave(3, 256)]]
    got = read_wac(wac(frames, flags=0x10))
    assert [(at, len(left)) for at, left, _ in got["segments"]] == [(256, 512), (1280, 256)]
    raw = wac(frames, flags=0x10)
    for bad in (b"nope" + raw[4:], raw[: len(raw) // 2], raw[:26] + b"\1\1" + raw[28:]):
        with pytest.raises(ValueError):
            read_wac(bad)


def zc(kind, dots, res1=25000, ratio=8, data_at=0x120, extra=b""):
    raw = bytearray(data_at)
    struct.pack_into("<H", raw, 0, 0x11A)
    raw[3] = kind
    raw[6:281] = b"".join(name.encode().ljust(n) for name, n in FIELDS)
    struct.pack_into("<HHBB", raw, 0x11A, data_at, res1, ratio, 0x52)
    if kind == 132:
        struct.pack_into("<HBBBBBBH", raw, 0x120, 2011, 3, 4, 5, 6, 7, 8, 90)
        raw[0x130:0x150] = b"WGS84     " + b"N4012345 W00367890" + b"1234"
        raw[0x150:data_at] = extra.ljust(data_at - 0x150)
    return bytes(raw) + dots


def test_zc_intervals_status_and_frequency():
    dots = bytes([0x80 | 2, 0, 0xA0, 1, 0, 5, 0x7B, 0xC0, 0, 2, 0, 0xE1, 3, 4, 4, 4, 0])
    z = read_zc(zc(131, dots))
    steps = [512, 256, 261, 256, 512]
    assert z["time_us"][:6] == [0, *np.cumsum(steps).tolist()]
    assert z["freq_hz"][2] == 8_000_000 // (512 + 256)
    assert z["status"][1] == 1 and z["status"][7] == 1 and z["metadata"]["SPECIES"] == "SPECIES"
    old = read_zc(zc(129, bytes([0b0_0001_010 | 0x80, 4, 6, 0xF9, 3])))
    assert old["time_us"][:3] == [0, (2 * 256 + 4) << 1, ((2 * 256 + 4) << 1) * 2 + 6]
    slow = read_zc(zc(130, bytes([0x80 | 2, 0, 1, 0]), res1=50000))
    assert slow["time_us"][:3] == [0, 1024, 1024 + 1026]


def test_zc_132_and_rewriting():
    z = read_zc(zc(132, bytes([0x84, 0, 1, 1]), data_at=0x180, extra=b"GUANO|Version: 1.0\nTE: 8"))
    assert z["metadata"]["DATE"] == "20110304_05:06:07.000890" and z["metadata"]["GPS"] == "WGS84 40.12345 N, 3.67890 W" and z["metadata"]["ALTITUDE"] == 1234
    assert z["guano"]["TE"] == "8"
    raw = zc(131, bytes([1, 2]))
    again = read_zc(write_zc(raw, read_zc(raw)["metadata"] | {"SPECIES": "Myotis" * 20, "NOTE": None}))
    assert again["metadata"]["SPECIES"] == ("Myotis" * 20)[:50] and again["metadata"]["NOTE"] == ""
    with pytest.raises(ValueError):
        read_zc(raw[:100])
    with pytest.raises(ValueError):
        read_zc(raw[:3] + b"\x85" + raw[4:])


def test_reading_through_spark(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(write_wav(np.arange(100), 8000, extra=[guano_chunk({"TE": "10", "Timestamp": "2020-01-02T03:04:05Z"})]))
    (tmp_path / "b_20200102_030405.wac").write_bytes(wac([None, [wave(1, 256)], None, [wave(2, 256)]], flags=0x10))
    (tmp_path / "c.zc").write_bytes(zc(131, bytes([0x84, 0, 1, 1])))
    r = S.read_audio(spark, [str(tmp_path / "*.wav"), str(tmp_path / "*.wac")], time_exp=2)
    rows = sorted(r.collect(), key=lambda x: x.recording_id)
    assert [(x.format, x.segment_idx, x.n_samples) for x in rows] == [("wav", 0, 100), ("wac", 0, 256), ("wac", 1, 256)]
    assert [x.filename for x in rows] == ["a.wav", "b_20200102_030405_002.wav", "b_20200102_030405_008.wav"]
    assert rows[0].sample_rate == 16000 and rows[0].guano["TE"] == "10"
    m = S.metadata(r.filter("format = 'wav'")).first()
    assert m.TE == 10 and m.Timestamp is not None
    z = S.read_zero_crossings(spark, str(tmp_path / "*.zc"))
    from pyspark.sql import functions as F

    dots = S.zc_dots(z)
    again = S.zc_frequency(dots, F.lit(8))
    assert sorted((d.idx, d.freq_hz) for d in dots.collect()) == sorted((d.idx, d.freq_hz) for d in again.collect())
    assert S.metadata(z).first().metadata["DIVRAT"] == "8"
    with pytest.raises(ValueError):
        S.read_audio(spark, str(tmp_path / "a.wav"), start=2, stop=1)


def test_mp3(spark, tmp_path):
    from echoframe.sources.mp3 import mp3_header

    raw = b"ID3\3\0\0\0\0\0\5hello" + bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(60)
    assert mp3_header(raw) == dict(sample_rate=44100, channels=2, kbits=128)
    (tmp_path / "x.MP3").write_bytes(raw)
    with pytest.raises(ValueError, match="44100 Hz"):
        S.decode("x.MP3", raw)
    out = S.mp3_to_wav(spark, str(tmp_path / "x.MP3"), lambda b: (22050, 16, [1, 2, 3], None)).collect()
    assert [r.filename for r in out] == ["x.wav"] and read_wav(bytes(out[0].content))["left"].tolist() == [1, 2, 3]


def test_amplitudes_follow_the_bit_depth(spark):
    from echoframe.operators import events as E
    from tests.test_kernels import chirps
    from tests.test_queries import recording

    from pyspark.sql import functions as F

    x, rate = chirps(count=2)
    r = recording(spark, x, rate)
    a, b = (E.threshold_detection(r.withColumn("bit_depth", F.lit(bits)), compat="textbook").select("amp_track").collect() for bits in (16, 24))
    assert np.allclose(np.array(a[0][0]) - np.array(b[0][0]), 20 * np.log10(2.0**8))
