"""The detector's trigger over streams of series: what it has seen of a series is a state of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.triggers import Settings, State, run


def stream_spans(values: DataFrame, keys: list[str], order: str, value: str, s: Settings = Settings(), idle_ms: int | None = None) -> DataFrame:
    """(keys, start, stop, peak, level): trigger_spans() of a stream of rows (keys, order, value), in append mode.

    For each key the state holds the trigger (noise window, decaying maximum, what is open)
    and the place and order of the last value, so the spans are those of one pass over
    all values, however the stream is cut into micro-batches.  order is a whole number that
    grows within a key; rows at or before the last one taken are late, or repeated, and are
    left out, as are null values.  Where idle_ms is given, a key without rows for so long
    (processing time) is forgotten, with a trigger that is open; its next value starts a
    series of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "start bigint, stop bigint, peak bigint, level double"])
    columns = [*keys, "start", "stop", "peak", "level"]

    def work(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).dropna(subset=[order, value]).sort_values(order, kind="stable")
        packed, seen, last = state.get if state.exists else (None, 0, None)
        rows = rows.drop_duplicates(order)
        if last is not None:
            rows = rows[rows[order] > last]
        if len(rows):
            spans, after = run(State.unpacked(packed) if packed else None, seen, rows[value].astype(float).tolist(), s)
            state.update((after.packed(), seen + len(rows), int(rows[order].iloc[-1])))
            if spans:
                yield pd.DataFrame([(*key, *x) for x in spans], columns=columns)
        if idle_ms and state.exists:
            state.setTimeoutDuration(idle_ms)

    plain = values.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    return plain.groupBy(*keys).applyInPandasWithState(work, schema, "state binary, seen bigint, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
