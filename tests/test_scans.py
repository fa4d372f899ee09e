"""Recurrences over chunks against loops over elements."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoframe.functions import regions, tracks
from echoframe.operators import scans


def smoothed(x, gain):
    y = [x[0]]
    for v in x[1:]:
        y.append((1 - gain) * v + gain * y[-1])
    return np.array(y)


def decayed(x, edg):
    y = [x[0]]
    for v in x[1:]:
        y.append(max(v, edg * y[-1] + (1 - edg) * v))
    return np.array(y)


CASES = {
    "kalman": (scans.kalman(1e-5, 1e-4), lambda x: tracks.kalman_track(x, 1e-5, 1e-4)),
    "smoothing": (scans.smoothing(0.25), lambda x: smoothed(x, 0.25)),
    "decaying_maximum": (scans.decaying_maximum(0.9), lambda x: decayed(x, 0.9)),
    "post_mask": (scans.post_mask(0.9), lambda x: regions.post_mask(x[None, :], 0.9)[0]),
    "background_subtract": (scans.background_subtract(2.5), lambda x: regions.background_subtract(x[None, :], 2.5)[0]),
}


@pytest.fixture(scope="module")
def series():
    """One long series, many short ones, one of a single element, a null key; extra column with a clashing name."""
    rng = np.random.default_rng(4)
    size = {"long": 5000, "one": 1, None: 40} | {f"s{k}": int(rng.integers(1, 30)) for k in range(60)}
    rows = [(k, t, float(v)) for k, n in size.items() for t, v in enumerate(rng.gamma(0.5, 20, n) - 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch", [13, 10_000])
@pytest.mark.parametrize("name", CASES)
def test_scans_equal_loops(spark, series, name, batch):
    recurrence, loop = CASES[name]
    d = spark.createDataFrame([(*r, "clash") for r in series], "k string, t bigint, x double, part string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scans.scan(d, ["k"], ["t"], "x", recurrence).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.DataFrame(series, columns=["k", "t", "x"]).sort_values(["k", "t"])
    assert len(got) == len(want)
    for key, rows in want.groupby("k", dropna=False):
        own = got[got.k.isna() if pd.isna(key) else got.k == key].sort_values("i")
        assert own.t.tolist() == rows.t.tolist() and own.i.tolist() == list(range(len(rows)))
        assert np.allclose(own.x, loop(rows.x.to_numpy()), rtol=1e-9, atol=1e-9)


def test_a_long_series_is_worked_on_by_many_tasks(spark):
    d = spark.range(400_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), (F.hash("id") % 1000).cast("double").alias("x"))
    cut = scans.chunks(d, ["k"], ["t"], "x")
    assert cut.select("part").distinct().count() == 4 and cut.agg(F.max("n")).first()[0] <= 10_000
    out = scans.scan(d, ["k"], ["t"], "x", scans.decaying_maximum(0.996))
    got = np.array(out.orderBy("i").select("x").toPandas().x)
    want = decayed(d.orderBy("t").toPandas().x.to_numpy(), 0.996)
    assert np.allclose(got, want)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_nothing_and_nulls(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0)], "k string, t bigint, x double")
    assert [(r.t, r.i, r.x) for r in scans.scan(d, ["k"], ["t"], "x", scans.smoothing(0.5)).orderBy("t").collect()] == [(1, 0, 2.0), (3, 1, 3.0)]
    assert scans.scan(d.limit(0), ["k"], ["t"], "x", scans.smoothing(0.5)).count() == 0


def test_composition_stops_at_segments():
    a, b, m = (np.array(v, dtype=float) for v in ([0, 0.5, 0, 0.5, 0.5], [1, 1, 2, 0, 0], [-np.inf, 0, -np.inf, 1.5, -np.inf]))
    _, b2, m2 = scans.composed((a, b, m), np.array([0, 0, 2, 2, 2]))
    assert np.maximum(b2, m2).tolist() == [1.0, 1.5, 2.0, 1.5, 0.75]
