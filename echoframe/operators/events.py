"""Detectors over DataFrames of recordings, and filters of their events."""

from __future__ import annotations

from dataclasses import asdict, replace
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detector, regions

_EVENTS = ", ".join(f"`{k}` {'string' if k == 'starting_time' else 'double'}" for k in detector.FEATURES)
THRESHOLD = f"recording_id string, filename string, {_EVENTS}, event_start bigint, event_end bigint, amp_track array<double>, freq_track array<double>, _from double, _to double"
_REGIONS = ", ".join(f"`{k}` {'string' if k == 'starting_time' else 'double'}" for k in regions.FEATURES)
#: Events that a detector gives to Spark at once.
ROWS = 1000
REGION = f"recording_id string, filename string, {_REGIONS}, first double, last double"


def channel(which: str = "left") -> Column:
    """Samples of a channel; mono recordings have the left one only."""
    if which not in ("left", "right"):
        raise ValueError("the channel must be left or right")
    return F.when((F.col("channels") > 1) & F.lit(which == "right"), F.col("right")).otherwise(F.col("left"))


def time_expanded(recordings: DataFrame, factor: float) -> DataFrame:
    """Rates of recordings that were slowed down by factor."""
    return recordings.withColumn("sample_rate", (F.col("sample_rate") * factor).cast("int")).withColumn("time_exp", F.col("time_exp") * factor)


def spacing_filter(events: DataFrame, start: Column, end: Column, low: float, high: float, keys: list[str], order: list[Column]) -> DataFrame:
    """Without both members of each pair of neighbours less than low or more than high apart (same unit as start and end)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = start - F.lag(end).over(w)
    bad = F.coalesce((gap < low) | (gap > high), F.lit(False))
    marked = events.withColumn("_bad", bad)
    return marked.withColumn("_next", F.coalesce(F.lead("_bad").over(w), F.lit(False))).filter(~F.col("_bad") & ~F.col("_next")).drop("_bad", "_next")


def duration_filter(events: DataFrame, duration: Column, low: float, high: float) -> DataFrame:
    return events.filter(duration.between(low, high))


def area_filter(events: DataFrame, area: Column, least: float) -> DataFrame:
    return events.filter(area > least)


def _limits(s, sample_rate: int):
    nyquist = sample_rate / 2
    return replace(s, LPF=nyquist if s.LPF is None else min(s.LPF, nyquist))


def _run(recordings: DataFrame, which: str, work, schema: str, columns: list[str]) -> DataFrame:
    """A detector for each recording where it lies: no shuffle. Its metadata travel with it where they are asked for."""
    guano = "guano" in columns

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                i, name, rate, bits, samples = (batch[c].iloc[k] for c in ("recording_id", "filename", "sample_rate", "bit_depth", "samples"))
                known = {"recording_id": i, "filename": name} | ({"guano": dict(batch["guano"].iloc[k] or {})} if guano else {})
                events = iter(work(np.asarray([] if samples is None else samples, dtype=np.int64), int(rate), int(bits or 16)))
                while rows := [known | e for e in islice(events, ROWS)]:
                    yield pd.DataFrame(rows, columns=columns)

    return recordings.select("recording_id", "filename", "sample_rate", "bit_depth", channel(which).alias("samples"), *(["guano"] if guano else [])).mapInPandas(run, schema)


def threshold_detection(recordings: DataFrame, channel: str = "left", acoustic_feat: bool = True, settings: bool = False, metadata: bool = False, **parameters) -> DataFrame:
    """Events of the adaptive signal-to-noise detector, with 27 features, tracks, start and end.

    Recordings too short, silent or without events give no rows; a trigger still open at
    the end of a recording gives none.
    """
    s = detector.Settings(**parameters)

    def work(samples, rate, bits):
        own = _limits(s, rate)
        for e in detector.detect(samples, rate, own):
            f = detector.extract(e, rate, own)
            reference = 2.0 ** (bits - 1)
            f["amp_track"] = [float(v) for v in np.maximum(20 * np.log10(np.maximum(np.array(f["amp_track"]), 1e-300) / reference), -6000)]
            yield f | {"_from": f["event_start"] * 1000 / rate, "_to": f["event_end"] * 1000 / rate}

    columns = ["recording_id", "filename", *detector.FEATURES, "event_start", "event_end", "amp_track", "freq_track", "_from", "_to"]
    found = _run(recordings, channel, work, *_with_metadata(THRESHOLD, columns, metadata))
    kept = spacing_filter(found, F.col("_from"), F.col("_to"), s.min_TBE, s.max_TBE, ["recording_id"], [F.col("event_start"), F.col("event_end")]).drop("_from", "_to")
    if not acoustic_feat:
        kept = kept.select("recording_id", "filename", "starting_time", "duration", "event_start", "event_end", *(["guano"] if metadata else []))
    return _attach(kept, s if settings else None)


def blob_detection(recordings: DataFrame, channel: str = "left", acoustic_feat: bool = True, settings: bool = False, metadata: bool = False, **parameters) -> DataFrame:
    """Events of the image-style region detector, with 26 features."""
    s = regions.Settings(**parameters)
    found = _run(recordings, channel, lambda samples, rate, bits: regions.found(samples, rate, _limits(s, rate)), *_with_metadata(REGION, ["recording_id", "filename", *regions.FEATURES, "first", "last"], metadata))
    kept = spacing_filter(found, F.col("first") * 1000, F.col("last") * 1000, s.min_TBE, s.max_TBE, ["recording_id"], [F.col("first"), F.col("last")])
    kept = kept.drop("first", "last") if acoustic_feat else kept.select("recording_id", "filename", "starting_time", "duration", *(["guano"] if metadata else []))
    return _attach(kept, s if settings else None)


def _with_metadata(schema: str, columns: list[str], metadata: bool) -> tuple[str, list[str]]:
    return (f"{schema}, guano map<string,string>", [*columns, "guano"]) if metadata else (schema, columns)


def _attach(events: DataFrame, settings) -> DataFrame:
    """Settings as a struct column."""
    if settings is not None:
        events = events.withColumn("settings", F.struct(*[F.lit(v).alias(k) for k, v in asdict(settings).items()]))
    return events


def batch_counts(events: DataFrame, prefix: str, one: str, other: str) -> DataFrame:
    """Events by a class taken from the beginning of the file name."""
    label = F.when(F.col("filename").startswith(prefix), one).otherwise(other)
    return events.groupBy(label.alias("label")).agg(F.count("*").alias("events"), F.avg("duration").alias("mean_duration"))


def train_test(events: DataFrame, share: float = 0.6, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A random split of rows."""
    a, b = events.randomSplit([share, 1 - share], seed)
    return a, b


def random_forest(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", trees: int = 200, seed: int = 1) -> DataFrame:
    """Confusion counts (label, prediction, count) of a random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(train)
    gather = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    model = RandomForestClassifier(labelCol="_y", featuresCol="_x", numTrees=trees, seed=seed).fit(gather.transform(index.transform(train)))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels + ["other"])
    return named.transform(model.transform(gather.transform(index.transform(test)))).groupBy(label, "predicted").count()
