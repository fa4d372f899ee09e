"""The chunked trigger against one pass, and one pass against the detector's own trigger."""

import numpy as np
import pytest

from echoframe.functions import detector
from echoframe.operators import triggers

S = triggers.Settings(threshold=6, window=20, edg=0.95, longest=30)


def noisy(seed, n):
    """Noise with bursts of different length and height."""
    rng = np.random.default_rng(seed)
    x = rng.gamma(4, 1, n)
    for _ in range(n // 60):
        a, m = int(rng.integers(0, n)), int(rng.integers(1, 60))
        x[a : a + m] *= rng.uniform(1.5, 8)
    return x.round(6).tolist()


def test_one_pass_is_the_trigger_of_the_detector():
    x = noisy(1, 3000)
    spans, _ = triggers.run(None, 0, x, S)
    frames = np.array(x)[:, None]
    own = detector.Trigger(frames[0], S.window, S.threshold, S.edg, 1, S.longest)
    found = [(k, got[0]) for k in range(1, len(x)) if (got := own.step(k, frames[k]))]
    assert len(spans) > 20 and [(stop, peak) for _, stop, peak, _ in spans] == found
    blocks = detector.triggered(frames[1:], np.arange(1, len(x)), detector.Trigger(frames[0], S.window, S.threshold, S.edg, 1, S.longest))
    assert [p for p, _ in blocks] == [p for _, p in found]


def test_states_are_exact():
    x = noisy(2, 500)
    whole, state = triggers.run(None, 0, x, S)
    parts, at = [], None
    for k in range(0, 500, 37):
        found, at = triggers.run(triggers.State.unpacked(at.packed()) if at else None, k, x[k : k + 37], S)
        parts += found
    assert parts == whole and at.packed() == state.packed()


@pytest.mark.parametrize("batch", [40, 150, 10_000])
def test_any_chunks_give_one_pass(spark, batch):
    series = {"a": noisy(3, 600), "b": noisy(4, 90), "c": [5.0], None: noisy(5, 300), "flat": [1.0] * 200, "open": [1.0] * 50 + [9.0] * 3}
    rows = [(k, t, v) for k, x in series.items() for t, v in enumerate(x)]
    d = spark.createDataFrame(rows, "k string, t bigint, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = triggers.trigger_spans(d, ["k"], ["t"], "x", S).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, *span) for k, x in series.items() for span in triggers.run(None, 0, x, S)[0]]
    assert sorted((str(r.k), r.start, r.stop, r.peak, round(r.level, 9)) for r in got) == sorted((str(k), a, b, p, round(level, 9)) for k, a, b, p, level in want)
    assert not [r for r in got if r.k in ("c", "flat", "open")]


def test_an_empty_table(spark):
    d = spark.createDataFrame([], "k string, t bigint, x double")
    assert triggers.trigger_spans(d, ["k"], ["t"], "x").count() == 0
