"""Table functions in SQL against the DataFrame operators and kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.functions import spectra
from echoframe.operators import events, table_functions


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark


def test_spacing_equals_the_filter(sql):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for k in range(400):
        at += int(rng.integers(1, 12))
        rows.append((f"r{k % 3}", at, at + int(rng.integers(0, 5)), k))
    d = sql.createDataFrame(rows, "recording_id string, a bigint, b bigint, n int").repartition(5)
    d.createOrReplaceTempView("spaced_rows")
    got = sql.sql("SELECT * FROM spaced(TABLE(spaced_rows), keys => 'recording_id', start => 'a', stop => 'b', low => 4, high => 20)")
    assert got.schema == d.schema
    want = events.spacing_filter(d, F.col("a"), F.col("b"), 4, 20, ["recording_id"], [F.col("a"), F.col("b")])
    assert sorted(got.collect()) == sorted(want.select(*d.columns).collect()) and 0 < want.count() < 400
    d.limit(0).createOrReplaceTempView("spaced_none")
    assert sql.sql("SELECT * FROM spaced(TABLE(spaced_none), keys => 'recording_id', start => 'a', stop => 'b', low => 4, high => 20)").count() == 0


def test_arguments_are_checked_when_a_statement_is_analysed(sql):
    sql.range(3).createOrReplaceTempView("three")
    with pytest.raises(Exception, match="no column nowhere"):
        sql.sql("SELECT * FROM spaced(TABLE(three), keys => 'id', start => 'nowhere', stop => 'id', low => 1, high => 2)")
    with pytest.raises(Exception, match="window is not implemented"):
        sql.sql("SELECT * FROM spectral_frames(TABLE(three), size => 64, overlap => 0.5, win => 'odd', compat => 'textbook')")
    with pytest.raises(Exception, match="no column left"):
        sql.sql("SELECT * FROM spectral_frames(TABLE(three), size => 64, overlap => 0.5, win => 'hann', compat => 'textbook')")


def test_frames_of_recordings(sql):
    x = np.random.default_rng(2).normal(0, 100, 3000).round()
    d = sql.createDataFrame([("a", "kept", x.tolist()), ("b", "empty", []), ("c", "null", None)], "recording_id string, frame string, left array<double>")
    d.createOrReplaceTempView("framed")
    out = sql.sql("SELECT * FROM spectral_frames(TABLE(framed), size => 128, overlap => 0.75, win => 'blackman4', compat => 'reference')")
    assert out.columns == ["recording_id", "frame", "frame_idx", "seek", "mag"]
    rows = sorted(out.collect(), key=lambda r: r.frame_idx)
    want = spectra.spectrogram(x, 128, 0.75, "blackman4")
    assert [(r.recording_id, r.frame, r.seek) for r in rows] == [("a", "kept", 32 * k) for k in range(len(want))] and np.allclose([r.mag for r in rows], want)
