"""Every query of the engine against its SQL twin, and the detectors over DataFrames."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from echoframe.operators import columns as C
from echoframe.operators import events as E
from echoframe.operators import frames as R
from echoframe.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple((k, round(v, 5) + 0.0 if isinstance(v, float) else v) for k, v in sorted(r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql_twin(spark, duck, name):
    got = plain(r.asDict() for r in Q.QUERIES[name](spark, DATA).collect())
    expected = plain(duck.sql(Q.SQL[name]).df().astype(object).where(lambda d: d.notna(), None).to_dict("records"))
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for (ka, va), (kb, vb) in zip(a, b):
            assert ka == kb and (va == vb or isinstance(va, float) and math.isclose(va, vb, abs_tol=2e-5)), (a, b)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("name", ["fspec", "spectro", "wav_ranges", "wav_round_trip"])
def test_samples_beside_a_half(spark, tmp_path, name, ansi):
    """Values whose product with 1000 lies beside a half, which floats can't hold: samples are those of exact products in SQL and query, whatever the session's rules of types."""
    import duckdb

    x = ((np.random.default_rng(3).integers(-500, 500, (200, 64)) + 0.5) / 1000).astype(np.float32)
    assert (np.rint(x * np.float32(1000)) != np.rint(x.astype(float) * 1000)).any()
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(k, [float(v) for v in row], k % 3) for k, row in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = plain(r.asDict() for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    expected = plain(duck.sql(Q.SQL[name]).df().astype(object).where(lambda d: d.notna(), None).to_dict("records"))
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for (ka, va), (kb, vb) in zip(a, b):
            assert ka == kb and (va == vb or isinstance(va, float) and math.isclose(va, vb, abs_tol=2e-5)), (a, b)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() >= 0


def recording(spark, samples, rate=250000, name="a"):
    return spark.createDataFrame([Row(recording_id=name, filename=f"{name}.wav", sample_rate=rate, bit_depth=16, channels=1, time_exp=1.0, left=[int(v) for v in samples], right=[], guano={"TE": "1"})], "recording_id string, filename string, sample_rate int, bit_depth int, channels int, time_exp double, left array<int>, right array<int>, guano map<string,string>")


def test_detection_of_chirps(spark):
    from tests.test_kernels import chirps

    x, rate = chirps()
    r = recording(spark, x, rate).unionByName(recording(spark, np.zeros(4000), rate, "silent")).unionByName(recording(spark, [], rate, "empty"))
    t = E.threshold_detection(r, compat="textbook", settings=True, metadata=True)
    rows = t.collect()
    assert len(rows) == 6 and {x.recording_id for x in rows} == {"a"} and rows[0].settings.threshold == 14 and rows[0].guano == {"TE": "1"}
    # neighbours are 92 ms apart: both members of a pair go when that is too near
    assert E.threshold_detection(r, compat="textbook", min_TBE=95).count() == 0
    assert E.threshold_detection(r, compat="textbook", acoustic_feat=False).columns == ["recording_id", "filename", "starting_time", "duration", "event_start", "event_end"]
    b = E.blob_detection(r)
    assert b.count() == 6 and b.columns[2:] == list(E.regions.FEATURES)


def test_chunked_frames_equal_whole(spark, monkeypatch):
    from echoframe.functions import spectra

    x = np.random.default_rng(4).integers(-1000, 1000, 5000)
    r = recording(spark, x, 8000)
    whole = spectra.spectrogram(x, 128, 0.75)
    real = R.chunks
    monkeypatch.setattr(R, "chunks", lambda *a, **k: real(*a, frames=16))
    got = sorted(R.fspec(r, FFT_size=128, FFT_overlap=0.75, to_dB=False).collect(), key=lambda v: v.frame_idx)
    assert [v.frame_idx for v in got] == list(range(len(whole)))
    assert np.allclose([v.mag for v in got], whole)
    cut = R.fspec(r, FFT_size=128, FFT_overlap=0.75, tlim=(0.1, 0.2), flim=(1000, 2000), to_dB=False)
    assert cut.count() == math.ceil((1600 - 800 + 1) / 32) and len(cut.first().mag) == 17
    assert R.spectro(r, FFT_size=128).agg(F.max(F.array_max("mag"))).first()[0] == 0


def test_spacing_flags_come_from_the_whole_list(spark):
    e = spark.createDataFrame([("a", 0, 1), ("a", 3, 4), ("a", 5, 6), ("a", 20, 21), ("b", 7, 8)], "r string, s int, e int")
    kept = E.spacing_filter(e, F.col("s"), F.col("e"), 2, 10, ["r"], [F.col("s")])
    assert sorted((x.r, x.s) for x in kept.collect()) == [("a", 0), ("b", 7)]
    single = E.spacing_filter(e.filter("r = 'b'"), F.col("s"), F.col("e"), 2, 10, ["r"], [F.col("s")])
    assert single.count() == 1


def test_column_operators_on_edges(spark):
    d = spark.createDataFrame([([],), ([0.0, 0.0],), ([1.0],)], "x array<double>")
    rows = d.select(C.centroid(F.col("x")).alias("c"), C.gini(F.col("x")).alias("g"), C.to_db_ref(C.total(F.col("x"))).alias("d")).collect()
    assert [r.c for r in rows] == [0, 0, 0] and [r.g for r in rows][:2] == [1, 1] and rows[0].d == float("-inf")


def test_batch_helpers(spark):
    e = spark.createDataFrame([(f"{'p' if k % 2 else 'n'}{k}.wav", float(k), float(-k) if k % 2 else float(k)) for k in range(40)], "filename string, duration double, x double")
    assert {r.label: r.events for r in E.batch_counts(e, "p", "pos", "neg").collect()} == {"pos": 20, "neg": 20}
    labelled = e.withColumn("label", F.when(F.col("filename").startswith("p"), "pos").otherwise("neg"))
    a, b = E.train_test(labelled, 0.6, 3)
    assert a.count() + b.count() == 40
    table = E.random_forest(a, b, ["duration", "x"], trees=10)
    assert sum(r["count"] for r in table.collect()) == b.count()
