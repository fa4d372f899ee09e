"""Array and recurrence operators as built-in column expressions (JVM only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tracks import KERNEL

FLOOR = 1e-6
EPSILON = 2.220446049250313e-16


def let(value: Column, use) -> Column:
    """use(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def at(x: Column, i: Column) -> Column:
    """0-based element, null outside."""
    return F.get(x, i.cast("int"))


def to_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(FLOOR)))


def to_db_ref(x: Column, ref: float = 1.0) -> Column:
    """Decibels without a floor: minus infinity at 0, where log10 alone would be null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(x / ref))


def hann(x: Column, n: int) -> Column:
    return F.transform(x, lambda v, i: v * (0.5 * (1 - F.cos(i * (2 * math.pi / (n - 1))))))


def dft(x: Column, n: int, pairing: str = "textbook") -> Column:
    """n/2 magnitudes of n samples; 'reference' pairs real parts with the next bin's imaginary part. The waves are literals: a multiplication and a sum for each bin and sample."""
    def waves(bins: list[tuple]) -> Column:
        rows = (",".join(f"{wave(2 * math.pi * k * j / n)!r}D" for j in range(n)) for wave, k in bins)
        return F.expr(f"array({','.join(f'array({r})' for r in rows)})")

    def parts(bins: list[tuple]) -> Column:
        products = lambda w: F.zip_with(F.slice(x, 1, n), w, lambda v, c: F.coalesce(v * c, F.lit(0.0)))
        return F.transform(waves(bins), lambda w: F.aggregate(products(w), F.lit(0.0), lambda a, v: a + v))

    half = n // 2
    other = [(math.sin, k) for k in range(half)] if pairing == "textbook" else [*((math.sin, k + 1) for k in range(half - 1)), (math.cos, half)]
    return F.zip_with(parts([(math.cos, k) for k in range(half)]), parts(other), lambda a, b: F.sqrt(a * a + b * b))


def band_pass(x: Column, lpf: float, hpf: float, resolution: float) -> Column:
    return F.transform(x, lambda v, i: F.when((i > lpf / resolution) | (i < hpf / resolution), 0.0).otherwise(v))


def normalise_clip(x: Column, most: Column, floor: float = -120.0) -> Column:
    return F.transform(x, lambda v: F.greatest(v - most, F.lit(floor)))


def centroid(x: Column) -> Column:
    """0-based; 0 if empty."""
    s = total(x)
    return F.when(s == 0, 0.0).otherwise(total(F.transform(x, lambda v, i: v * i)) / s)


def moments(x: Column) -> Column:
    """struct(centroid from 1, bandwidth, skew, excess kurtosis) of weights."""
    def around(w, c):
        power = lambda k: total(F.transform(w, lambda v, i: v * F.pow(i + 1 - c, F.lit(k))))
        return let(F.sqrt(power(2)), lambda sd: F.struct(
            c.alias("centroid"), sd.alias("bandwidth"),
            F.when(sd > EPSILON, power(3) / F.pow(sd, F.lit(3))).otherwise(0.0).alias("skew"), F.when(sd > EPSILON, power(4) / F.pow(sd, F.lit(4)) - 3).otherwise(0.0).alias("kurtosis"),
        ))

    weights = let(F.greatest(total(x), F.lit(EPSILON)), lambda s: F.transform(x, lambda v: v / s))
    return let(weights, lambda w: let(total(F.transform(w, lambda v, i: v * (i + 1))), lambda c: around(w, c)))


def gini(x: Column) -> Column:
    return let(total(x), lambda s: F.when(s > EPSILON, 1 - total(F.transform(x, lambda v: (v / s) * (v / s)))).otherwise(1.0))


def argmax(x: Column) -> Column:
    """0-based first place of the maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def quad_peak(x: Column, i: Column) -> Column:
    a, b, c = at(x, i - 1), at(x, i), at(x, i + 1)
    return F.when((i < 3) | c.isNull(), 0.0).otherwise(i + (c - a) / (2 * (2 * b - a - c)))


def kernel_mask(x: Column, peak: Column, compat: str = "reference") -> Column:
    """x times a binomial kernel around the peak (one bin higher in the reference)."""
    kernel = F.array(*[F.lit(float(k)) for k in KERNEL])
    shift = len(KERNEL) // 2 - (1 if compat == "reference" else 0)
    return F.transform(x, lambda v, i: v * F.coalesce(F.when((i - peak + shift >= 0) & (i - peak + shift < len(KERNEL)), F.get(kernel, (i - peak + shift).cast("int"))), F.lit(0.0)))


def blur(x: Column, factor: float) -> Column:
    """Each inner element: factor times itself plus its neighbours."""
    return F.transform(x, lambda v, i: F.when((i == 0) | (i == F.size(x) - 1), v).otherwise(factor * v + F.get(x, i - 1) + F.get(x, (i + 1).cast("int"))))


def contrast_boost(x: Column, boost: float) -> Column:
    """Minus a share of the rest outside seven neighbours; three elements at each end are 0."""
    def boosted(z, s):
        near = lambda i: sum((F.get(z, (i + k).cast("int")) for k in range(-3, 4)), F.lit(0.0))
        return F.transform(z, lambda v, i: F.when((i < 3) | (i >= F.size(z) - 3), 0.0).otherwise(F.greatest(F.lit(0.0), v - (s - near(i)) * (F.lit(float(boost)) / (F.size(z) - 7)))))

    edges = F.transform(x, lambda v, i: F.when((i < 3) | (i >= F.size(x) - 3), 0.0).otherwise(v))
    return let(edges, lambda z: let(total(z), lambda s: boosted(z, s)))


def snr(x: Column, noise: Column) -> Column:
    """Decibels of signal over noise over the elements above the noise."""
    above = F.filter(F.arrays_zip(x.alias("x"), noise.alias("n")), lambda p: p["x"] > p["n"])
    return to_db(total(F.transform(above, lambda p: p["x"])) / F.greatest(total(F.transform(above, lambda p: p["n"])), F.lit(FLOOR)))


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm, truncated."""
    ms = F.floor(seconds * 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
