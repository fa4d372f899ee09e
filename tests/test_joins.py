"""Joins in time and sessions, in batch and on streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoframe.operators import joins, triggers
from echoframe.streaming.triggers import stream_spans
from tests.test_triggers import S, noisy


def intervals(seed, n, hot=0.4):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot, "hot", rng.choice(list("abc"), n))
    a = rng.integers(-500, 3000, n)
    length = np.where(rng.random(n) < 0.1, rng.integers(0, 3000, n), rng.integers(0, 20, n))
    return [(str(k), int(x), int(x + m)) for k, x, m in zip(keys, a, length)]


@pytest.mark.parametrize("heavy", [3, 50, 20_000])
def test_overlaps_are_reported_once(spark, heavy):
    left, right = intervals(1, 300), intervals(2, 250)
    left += [left[0], ("a", 5, 1), (None, 0, 10), ("a", None, 3)]
    right += [("a", 7, 7), ("a", 9, 2), (None, 0, 10), ("b", 0, None)]
    x = spark.createDataFrame([(*r, k) for k, r in enumerate(left)], "k string, xa bigint, xb bigint, x int")
    y = spark.createDataFrame([(*r, k) for k, r in enumerate(right)], "k string, ya int, yb int, y int")
    out = joins.overlap_join(x, y, ["k"], ("xa", "xb"), ("ya", "yb"), heavy)
    got = sorted((r.x, r.y) for r in out.collect())
    ok = lambda r: None not in r and r[1] <= r[2]
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if ok(a) and ok(b) and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert got == want and len(want) > 500
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_overlaps_of_nothing(spark):
    x = spark.createDataFrame([("a", 1, 2)], "k string, xa bigint, xb bigint")
    y = spark.createDataFrame([], "k string, ya bigint, yb bigint")
    assert joins.overlap_join(x, y, ["k"], ("xa", "xb"), ("ya", "yb")).count() == 0
    assert joins.overlap_join(y.toDF("k", "xa", "xb"), x.toDF("k", "ya", "yb"), ["k"], ("xa", "xb"), ("ya", "yb")).count() == 0
    with pytest.raises(ValueError, match="differ"):
        joins.overlap_join(x, x, ["k"], ("xa", "xb"), ("xa", "xb"))


def test_the_last_reading_before(spark):
    rng = np.random.default_rng(3)
    key = lambda n: np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcde"), n)).tolist()
    events = [(k, int(t), i) for i, (k, t) in enumerate(zip(key(600), rng.integers(0, 400, 600)))] + [("hot", 5, 600), ("hot", 5, 601), (None, 7, 602), ("a", None, 603), ("new", 9, 604)]
    readings = [(k, int(t), float(v)) for k, t, v in zip(key(150), rng.integers(50, 400, 150), rng.integers(0, 9, 150))] + [(None, 1, 1.0), ("a", None, 2.0), ("hot", 60, None)]
    e = spark.createDataFrame(events, "k string, t int, id int")
    r = spark.createDataFrame(readings, "k string, rt int, v double")
    got = sorted((x.id, x.rt, x.v) for x in joins.as_of_join(e.repartition(6), r.repartition(3), ["k"], "t", "rt", ["rt", "v"]).collect())
    want = []
    for k, t, i in events:
        best = max(((rt, -1.0 if v is None else v) for rk, rt, v in readings if None not in (k, t, rk, rt) and rk == k and rt <= t), default=(None, None))
        want.append((i, best[0], None if best[1] == -1.0 else best[1]))
    assert got == sorted(want, key=lambda x: x[0])
    assert [tuple(x) for x in joins.as_of_join(e.limit(1), r.limit(0), ["k"], "t", "rt", ["rt", "v"]).collect()] == [(*events[0], None, None)]
    assert joins.as_of_join(e.limit(0), r, ["k"], "t", "rt", ["v"]).count() == 0


def test_a_hot_key_of_readings_lies_in_many_tasks(spark):
    e = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    r = spark.range(0, 100_000, 30_000).select(F.lit("hot").alias("k"), F.col("id").alias("rt"))
    out = joins.as_of_join(e, r, ["k"], "t", "rt", ["rt"])
    assert out.filter("rt != t - t % 30000").count() == 0 and out.count() == 100_000


def replay(spark, tmp_path, batches, make, checkpoint="cp", out="out"):
    """Rows written by a stream that finds one more file each time it is started, so every micro-batch follows a restart."""
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    for k, (name, rows) in enumerate(batches):
        rows.to_json(source / f"{name}.json", orient="records", lines=True, date_format="iso")
        q = make(source).writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / checkpoint)).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.parquet(str(tmp_path / out))


@pytest.mark.parametrize("cuts", [(10, 130, 320)])
def test_trigger_spans_of_a_stream_are_those_of_the_batch(spark, tmp_path, cuts):
    series = {"a": noisy(11, 400), "b": noisy(12, 200)}
    rows = pd.DataFrame([(k, t, v) for k, x in series.items() for t, v in enumerate(x)], columns=["k", "t", "x"])
    edges = [0, *cuts, 10_000]
    batches = [(f"p{n}", pd.concat([rows[(rows.t >= a) & (rows.t < b)].sample(frac=1, random_state=1), rows[(rows.t >= max(a - 5, 0)) & (rows.t < a)]])) for n, (a, b) in enumerate(zip(edges, edges[1:]))]  # with some late rows
    make = lambda source: stream_spans(spark.readStream.schema("k string, t bigint, x double").json(str(source)), ["k"], "t", "x", S)
    got = replay(spark, tmp_path, batches, make)
    want = sorted((k, *span) for k, x in series.items() for span in triggers.run(None, 0, x, S)[0])
    assert sorted((r.k, r.start, r.stop, r.peak, r.level) for r in got.collect()) == want and want


def test_idle_series_are_forgotten(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    x = noisy(14, 150)
    put = lambda name, low: pd.DataFrame(dict(k="a", t=range(low, low + 150), x=x)).to_json(tmp_path / "in" / name, orient="records", lines=True)
    put("a.json", 0)
    source = spark.readStream.schema("k string, t bigint, x double").json(str(tmp_path / "in"))
    q = stream_spans(source, ["k"], "t", "x", S, idle_ms=1).writeStream.format("memory").queryName("idle").outputMode("append").start()
    try:
        for name, rows in (("b.json", 1), ("", 2)):
            end = time.time() + 60
            while time.time() < end and spark.table("idle").count() < rows * len(triggers.run(None, 0, x, S)[0]):
                time.sleep(0.3)
            time.sleep(2)  # batches without rows time the key out
            if name:
                put(name, 0)  # the same places: taken, as nothing is known of them
    finally:
        q.stop()
    spans = [(r.start, r.stop, r.peak) for r in spark.table("idle").collect()]
    assert sorted(spans) == sorted([(a, b, p) for a, b, p, _ in triggers.run(None, 0, x, S)[0]] * 2) and spans


def test_bouts_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(13)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 50_000, 400)), unit="s")
    rows = pd.DataFrame(dict(k=rng.choice(list("ab"), 400), t=at))
    last = pd.DataFrame(dict(k=["z"], t=[pd.Timestamp("2024-02-01")]))  # moves the watermark behind all others
    late = pd.DataFrame(dict(k=["a"], t=[pd.Timestamp("2024-01-01")]))  # behind it: dropped
    batches = [("p0", rows[:130]), ("p1", rows[130:300]), ("p2", rows[300:]), ("p3", last), ("p4", late), ("p5", last.assign(k="y", t=pd.Timestamp("2024-03-01")))]
    read = lambda source: spark.readStream.schema("k string, t timestamp").json(str(source)).withWatermark("t", "1 hour")
    got = replay(spark, tmp_path, batches, lambda source: joins.bouts(read(source), ["k"], "t", "10 minutes"))
    batch = joins.bouts(spark.createDataFrame(pd.concat([rows, last]), "k string, t timestamp"), ["k"], "t", "10 minutes")
    key = lambda r: (r.k, r.start, r.end, r.events)
    assert sorted(map(key, got.filter("k != 'y'").collect())) == sorted(map(key, batch.collect()))
    want = rows.sort_values(["k", "t"]).groupby("k").t.apply(lambda t: (t.diff() >= pd.Timedelta("10min")).sum() + 1).sum()
    assert batch.filter("k != 'z'").count() == want


def test_bouts_leave_out_rows_without_a_time(spark):
    d = spark.createDataFrame([("a", None), ("a", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(str(r.k) for r in joins.bouts(d, ["k"], "t", "1 hour").collect()) == ["None", "a"]
