"""Arriving files, and pictures."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.sources import report
from echoframe.sources.wav import write_wav
from echoframe.streaming.folder import detect_arrivals

from .test_kernels import chirps


def test_arrivals_are_detected_once(spark, tmp_path):
    x, rate = chirps(count=2)
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(write_wav(x, rate))
    for _ in range(2):
        detect_arrivals(spark, inbox, out, state, available_now=True, compat="textbook").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "in/b.wav").write_bytes(write_wav(x, rate))
    detect_arrivals(spark, inbox, out, state, available_now=True, compat="textbook").awaitTermination()
    assert spark.read.parquet(out).groupBy("filename").count().collect() != [] and spark.read.parquet(out).count() == 4


def test_pictures(spark, tmp_path):
    raw = report.png(np.arange(6).reshape(2, 3))
    assert raw[:4] == b"\x89PNG" and zlib.decompress(raw[raw.index(b"IDAT") + 4 :][: -16]) == bytes([0, 0, 1, 2, 0, 3, 4, 5])
    assert report.zc_png([0, 10, 20], [None, 40000.0, 1.0])[:4] == b"\x89PNG"
    from .test_queries import recording

    r = recording(spark, np.random.default_rng(0).integers(-99, 99, 2000), 8000)
    pictures = report.event_pictures(r, spark.createDataFrame([("a", 100, 900), ("a", 1500, 1990)], "recording_id string, event_start bigint, event_end bigint"), time_scale=1, size=64).collect()
    assert sorted(p.event_start for p in pictures) == [100, 1500] and all(bytes(p.picture)[:4] == b"\x89PNG" for p in pictures)


def test_event_reports(spark, tmp_path):
    from .test_queries import recording

    samples = np.random.default_rng(0).integers(-99, 99, 4000)
    r = recording(spark, samples, 8000)
    many = r.unionByName(r.withColumn("recording_id", F.lit("b <x>"))).repartition(4)
    rows = [(i, k * 100 + 1, k * 100 + 60, f"{k}&") for k in range(30) for i in ("a", "b <x>")]
    events = spark.createDataFrame(rows, "recording_id string, event_start int, event_end int, note string")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    out = tmp_path / "report"
    report.event_report(many, events, str(out), ["note", "event_end"], time_scale=1, size=64)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - jobs < 12
    page = (out / "index.html").read_text()
    names = re.findall(r"img src='([^']+)'", page)
    assert len(names) == 60 == len(set(names)) == len(list(out.glob("*.png"))) and all((out / n).read_bytes()[:4] == b"\x89PNG" for n in names)
    assert page.count("<h2>") == 2 and "b &lt;x&gt;" in page and "<td>7&amp;</td><td>760</td>" in page
    assert [int(n.split("_")[1][:-4]) for n in names] == [k * 100 + 1 for k in range(30)] * 2
    report.event_report(many, events.limit(0).union(events.filter("recording_id = 'a' and event_start = 1")), str(out), ["note"], time_scale=1, size=64)
    assert sorted(p.name for p in out.iterdir()) == sorted([names[0], "index.html"])
    with pytest.raises(Exception, match="two events"):
        report.event_report(many, events.filter("event_start = 1").withColumn("event_end", F.explode(F.array(F.lit(60), F.lit(70)))), str(out), ["note"], time_scale=1, size=64)
    assert sorted(p.name for p in out.iterdir()) == sorted([names[0], "index.html"])
