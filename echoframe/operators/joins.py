"""Joins in time: events with annotations that overlap them, and with the last reading before them.

overlap_join cuts time into bins whose width follows from the length of intervals: two
intervals meet at the level of the longer one, where each lies in two bins at most, and a
pair is reported in the bin in which its overlap begins, so once.  Bins with many rows on
the right are split, and the left rows of such a bin go to every part.  The plan is an
equi-join on key, level and bin.

as_of_join unites both sides, sorts them into ranges of key and time and takes the last
reading within each range; what stands before a range is carried in from the ranges before
it, of which a row each is looked at.  So one key's rows lie in many tasks.

Defined results: intervals are closed, and rows with a null bound or an end before the
start have no partner; null keys join with nothing; rows that repeat are rows of their own;
empty tables give empty results (as_of_join: events with nulls); columns of both sides are
kept under their names, so they must differ but for the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Right rows of a bin from which on it is split, each part about as large.
HEAVY = 20_000


def _level(start: Column, end: Column) -> Column:
    """The least k for which an interval is no longer than 2**k."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], heavy: int = HEAVY) -> DataFrame:
    """Pairs of rows with equal keys whose intervals (whole numbers, ends included) have a point in common."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides must differ but for the keys: {sorted(clash)}")

    def side(df: DataFrame, bounds: tuple[str, str], name: str) -> DataFrame:
        a, b = (F.col(c).cast("long") for c in bounds)
        known = df.filter((b >= a) & F.expr(" and ".join(f"`{k}` is not null" for k in keys)) if keys else b >= a)
        return known.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(*df.columns).alias(f"_{name}"), a.alias(f"_{name}_a"), b.alias(f"_{name}_b"), _level(a, b).alias(f"_{name}_level"))

    x, y = side(left, left_bounds, "x"), side(right, right_bounds, "y")
    # at most 64 levels a side
    levels = {n: sorted(r[0] for r in d.select(f"_{n}_level").distinct().collect()) for n, d in (("x", x), ("y", y))}

    def binned(df: DataFrame, name: str, other: list[int]) -> DataFrame:
        """A row for each bin, at the own level and at those of longer intervals on the other side."""
        own = F.col(f"_{name}_level")
        at = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda k: k > own)))
        d = df.withColumn("_level", F.explode(at))
        first, last = F.call_function("shiftright", f"_{name}_a", F.col("_level")), F.call_function("shiftright", f"_{name}_b", F.col("_level"))
        return d.withColumn("_bin", F.explode(F.sequence(first, last)))

    x, y = binned(x, "x", levels["y"]), binned(y, "y", levels["x"])
    spot = [*[f"_y_{k}" for k in keys], "_level", "_bin"]
    split = y.groupBy(*spot).agg(F.ceil(F.count("*") / heavy).cast("int").alias("_parts")).filter("_parts > 1")
    y = y.join(split, spot, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_y", F.monotonically_increasing_id()), F.col("_parts")).cast("int"))).drop("_parts")
    split = split.select(*[F.col(f"_y_{k}").alias(f"_x_{k}") for k in keys], "_level", "_bin", "_parts")
    x = x.join(split, [*[f"_x_{k}" for k in keys], "_level", "_bin"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    y = y.withColumnsRenamed({c: f"_r{c}" for c in ("_level", "_bin", "_part")})
    same = (F.col("_level") == F.col("_r_level")) & (F.col("_bin") == F.col("_r_bin")) & (F.col("_part") == F.col("_r_part"))
    for k in keys:
        same = same & (F.col(f"_x_{k}") == F.col(f"_y_{k}"))
    begins = F.greatest("_x_a", "_y_a")
    met = (F.col("_level") == F.greatest("_x_level", "_y_level")) & (begins <= F.least("_x_b", "_y_b")) & (F.call_function("shiftright", begins, F.col("_level")) == F.col("_bin"))
    pairs = x.join(y, same & met)
    return pairs.select(*[F.col(f"_x.{c}").alias(c) for c in left.columns], *[F.col(f"_y.{c}").alias(c) for c in right.columns if c not in keys])


def as_of_join(events: DataFrame, readings: DataFrame, keys: list[str], at: str, reading_at: str, values: list[str]) -> DataFrame:
    """Events with the values of the last reading of their key at their time or before it (nulls without one).

    Readings of one time are ordered by their values, and the greatest counts; readings
    without a time aren't looked at.
    """
    kept = [c for c in events.columns if c not in keys]
    reading = F.struct(F.col(reading_at).alias("at"), *values)
    new = readings.filter(F.col(reading_at).isNotNull()).select(*keys, F.col(reading_at).alias("_at"), F.lit(0).alias("_kind"), reading.alias("_reading"), F.lit(None).cast(events.select(F.struct(*kept).alias("s")).schema["s"].dataType).alias("_event"))
    old = events.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(new.schema["_reading"].dataType).alias("_reading"), F.struct(*kept).alias("_event"))
    order = [*keys, "_at", "_kind", "_reading"]
    both = new.unionByName(old).withColumn("_row", F.monotonically_increasing_id())
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(both.repartitionByRange(n, *order, "_row").withColumn("_part", F.spark_partition_id()), "as-of")
    last = F.last("_reading", ignorenulls=True)
    within = Window.partitionBy("_part", *keys).orderBy("_at", "_kind", "_reading")
    filled = ranges.withColumn("_found", last.over(within.rowsBetween(Window.unboundedPreceding, 0))).filter("_kind = 1")
    # the last reading of a key's ranges, a row each, and what each range gets from those before it
    ends = ranges.filter("_kind = 0").groupBy(*keys, "_part").agg(F.max("_reading").alias("_reading"))
    parts = ranges.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_carried", last.over(before)).filter("_carried is not null").select(*keys, "_part", "_carried")
    null_key = F.expr(" or ".join(f"`{k}` is null" for k in keys)) if keys else F.lit(False)
    joined = filled.join(carried, [*keys, "_part"], "left").withColumn("_found", F.when(~null_key & F.col("_at").isNotNull(), F.coalesce("_found", "_carried")))
    out = joined.select(*keys, *[F.col(f"_event.{c}").alias(c) for c in kept], *[F.col(f"_found.{v}").alias(v) for v in values])
    return out.select(*events.columns, *values)


def bouts(events: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """(keys, start, end, events): sessions of events, each less than gap (such as '90 seconds') behind the one before it; batch or stream.

    time is a timestamp; rows without one belong to no session.  On a stream the watermark
    of time says when a session is over, and rows behind it are dropped.
    """
    return events.filter(F.col(time).isNotNull()).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events")).drop("_w")
