"""One query per operator over the driver's tables, with its SQL twin where SQL can say it.

An embedding is a frame of 64 samples; its absolute values times 10 serve as a
spectrum.  The values of a user's events in order of time are a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import events as E
from ..operators import frames as R
from ..operators import joins as J
from ..operators import pixels as P
from ..operators import scans as N
from ..operators import series as K
from ..operators import table_functions as U
from ..operators import triggers as T
from ..operators.storage import new_folder
from ..functions import detector, regions
from ..functions.spectra import WINDOWS
from ..sources import datasource as D
from ..sources import recordings as S
from ..sources.guano import parse_guano

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = 6):
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def frames(spark, sf_dir) -> DataFrame:
    """(vec_id, x): samples of each frame."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def spectra(spark, sf_dir) -> DataFrame:
    """(vec_id, x): a spectrum of each frame."""
    return frames(spark, sf_dir).withColumn("x", F.transform("x", lambda v: F.abs(v) * 10))


def series(spark, sf_dir) -> DataFrame:
    """(user_id, i, x): a series for each user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("x"))
    return e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


def tracks(spark, sf_dir) -> DataFrame:
    """(user_id, x): a series as an array."""
    packed = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("x"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(packed.alias("s")).select("user_id", F.col("s.x").alias("x"))


def scanned(spark, sf_dir, recurrence: N.Recurrence, name: str) -> DataFrame:
    """(user_id, i, name): a recurrence over each user's series."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("x"))
    return N.scan(e, ["user_id"], ["ts", "event_id"], "x", recurrence).select("user_id", "i", rounded(F.col("x")).alias(name))


def spread(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """One row an element."""
    return df.select(key, F.posexplode(column).alias("i", "v")).select(key, F.col("i").cast("long").alias("i"), rounded(F.col("v")).alias(name))


_E = "e AS (SELECT vec_id, UNNEST(range(0, len(embedding))) AS i, UNNEST(embedding)::DOUBLE AS s, len(embedding) AS n FROM embeddings)"
_P = _E + ", p AS (SELECT vec_id, i, n, abs(s) * 10 AS x FROM e)"
_S = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value::DOUBLE AS x FROM events)"
_TURN = 2 * math.pi / 64


@query(f"""WITH {_E}, b AS (SELECT UNNEST(range(0, 32)) AS k), f AS (
SELECT vec_id, k, sum(s * cos({_TURN!r} * k * i)) AS re, sum(s * sin({_TURN!r} * k * i)) AS im FROM e, b GROUP BY ALL)
SELECT vec_id, k::BIGINT AS i, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude FROM f""")
def dft_magnitude(spark, sf_dir):
    return spread(frames(spark, sf_dir).withColumn("m", C.dft(F.col("x"), 64)), "vec_id", "m", "magnitude")


@query(f"""WITH {_E}, w AS (SELECT vec_id, i, s * (0.5 * (1 - cos(i * {2 * math.pi / 63!r}))) AS s FROM e), b AS (SELECT UNNEST(range(0, 33)) AS k), f AS (
SELECT vec_id, k, sum(s * cos({_TURN!r} * k * i)) AS re, sum(s * sin({_TURN!r} * k * i)) AS im FROM w, b GROUP BY ALL)
SELECT a.vec_id, a.k::BIGINT AS i, round(sqrt(a.re * a.re + CASE WHEN a.k < 31 THEN c.im * c.im ELSE c.re * c.re END), 6) + 0.0 AS magnitude
FROM f a JOIN f c ON a.vec_id = c.vec_id AND c.k = a.k + 1 WHERE a.k < 32""")
def hann_magnitude_refpair(spark, sf_dir):
    x = frames(spark, sf_dir).withColumn("x", C.hann(F.col("x"), 64))
    return spread(x.withColumn("m", C.dft(F.col("x"), 64, "reference")), "vec_id", "m", "magnitude")


@query(f"WITH {_P} SELECT vec_id, i::BIGINT AS i, round(20 * log10(greatest(x, 1e-6)), 6) + 0.0 AS db FROM p")
def magnitude_db(spark, sf_dir):
    return spread(spectra(spark, sf_dir).withColumn("d", F.transform("x", C.to_db)), "vec_id", "d", "db")


@query(f"WITH {_P} SELECT vec_id, i::BIGINT AS i, round(CASE WHEN i > 40000 / 1000.0 OR i < 8000 / 1000.0 THEN 0 ELSE x END, 6) + 0.0 AS magnitude FROM p")
def band_pass(spark, sf_dir):
    return spread(spectra(spark, sf_dir).withColumn("b", C.band_pass(F.col("x"), 40000, 8000, 1000.0)), "vec_id", "b", "magnitude")


@query(f"""WITH {_P}, d AS (SELECT vec_id, i, 20 * log10(greatest(x, 1e-6)) AS db FROM p)
SELECT vec_id, i::BIGINT AS i, round(greatest(db - max(db) OVER (PARTITION BY vec_id), -40), 6) + 0.0 AS db FROM d""")
def normalise_clip(spark, sf_dir):
    d = spectra(spark, sf_dir).withColumn("d", F.transform("x", C.to_db))
    return spread(d.withColumn("d", C.normalise_clip(F.col("d"), F.array_max("d"), -40.0)), "vec_id", "d", "db")


@query(f"""WITH {_P}, w AS (SELECT vec_id, i + 1 AS k, x / greatest(sum(x) OVER (PARTITION BY vec_id), 2.220446049250313e-16) AS w FROM p),
c AS (SELECT *, sum(w * k) OVER (PARTITION BY vec_id) AS c FROM w),
m AS (SELECT vec_id, min(c) AS c, sqrt(sum(w * (k - c) ** 2)) AS sd, sum(w * (k - c) ** 3) AS m3, sum(w * (k - c) ** 4) AS m4 FROM c GROUP BY vec_id)
SELECT vec_id, round(c, 6) + 0.0 AS centroid, round(sd, 6) + 0.0 AS bandwidth, round(m3 / sd ** 3, 6) + 0.0 AS skew, round(m4 / sd ** 4 - 3, 6) + 0.0 AS kurtosis FROM m""")
def spectral_moments(spark, sf_dir):
    m = spectra(spark, sf_dir).withColumn("m", C.moments(F.col("x")))
    return m.select("vec_id", *[rounded(F.col(f"m.{k}")).alias(k) for k in ("centroid", "bandwidth", "skew", "kurtosis")])


@query(f"""WITH {_P}, w AS (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS w FROM p)
SELECT vec_id, round(1 - sum(w * w), 6) + 0.0 AS gini FROM w GROUP BY vec_id""")
def gini_impurity(spark, sf_dir):
    return spectra(spark, sf_dir).select("vec_id", rounded(C.gini(F.col("x"))).alias("gini"))


_QUANTILES = (0.025, 0.25, 0.5, 0.75, 0.975)


@query(f"""WITH {_P}, r AS (SELECT vec_id, i, sum(x) OVER (PARTITION BY vec_id ORDER BY i) AS c, sum(x) OVER (PARTITION BY vec_id) AS t FROM p)
SELECT vec_id, {', '.join(f"(min(i) FILTER (c >= {q} * t))::BIGINT AS q{k}" for k, q in enumerate(_QUANTILES))},
(min(i) FILTER (c >= 0.975 * t) - min(i) FILTER (c >= 0.025 * t))::BIGINT AS ci_95, (min(i) FILTER (c >= 0.75 * t) - min(i) FILTER (c >= 0.25 * t))::BIGINT AS ci_75 FROM r GROUP BY vec_id""")
def spectral_quantiles(spark, sf_dir):
    q = K.over_frames(spectra(spark, sf_dir), "vec_id", "x", lambda x: regions.quantile_bins(x, _QUANTILES))
    q = q.select("vec_id", *[F.get("x", F.lit(k)).cast("long").alias(f"q{k}") for k in range(5)])
    return q.withColumn("ci_95", F.col("q4") - F.col("q0")).withColumn("ci_75", F.col("q3") - F.col("q1"))


@query(f"""WITH {_P}, m AS (SELECT vec_id, min(i) AS i FROM (SELECT vec_id, i, x, max(x) OVER (PARTITION BY vec_id) AS t FROM p) WHERE x = t GROUP BY vec_id)
SELECT m.vec_id, m.i::BIGINT AS peak, round(CASE WHEN m.i < 3 OR c.x IS NULL THEN 0 ELSE m.i + (c.x - a.x) / (2 * (2 * b.x - a.x - c.x)) END, 6) + 0.0 AS place
FROM m LEFT JOIN p a ON a.vec_id = m.vec_id AND a.i = m.i - 1 LEFT JOIN p b ON b.vec_id = m.vec_id AND b.i = m.i LEFT JOIN p c ON c.vec_id = m.vec_id AND c.i = m.i + 1""")
def peak_quad(spark, sf_dir):
    m = spectra(spark, sf_dir).withColumn("k", C.argmax(F.col("x")))
    return m.select("vec_id", F.col("k").cast("long").alias("peak"), rounded(C.quad_peak(F.col("x"), F.col("k"))).alias("place"))


_KERNEL = "k(j, w) AS (VALUES (-5, 1), (-4, 12), (-3, 66), (-2, 220), (-1, 495), (0, 792), (1, 924), (2, 792), (3, 495), (4, 220), (5, 66), (6, 12), (7, 1))"


@query(f"""WITH {_P}, {_KERNEL}, m AS (SELECT vec_id, min(i) AS m FROM (SELECT vec_id, i, x, max(x) OVER (PARTITION BY vec_id) AS t FROM p) WHERE x = t GROUP BY vec_id),
g AS (SELECT p.vec_id, p.i, p.x * k.w / 4096.0 AS x FROM p JOIN m ON p.vec_id = m.vec_id JOIN k ON p.i = m.m + k.j)
SELECT vec_id, round(sum(x), 6) + 0.0 AS energy, round(sum(i * x) / sum(x), 6) + 0.0 AS centroid, round(2 * sum(i * x) / sum(x))::BIGINT AS harmonic FROM g GROUP BY vec_id""")
def kernel_mask_centroid(spark, sf_dir):
    m = spectra(spark, sf_dir).withColumn("g", C.kernel_mask(F.col("x"), C.argmax(F.col("x"))))
    return m.select("vec_id", rounded(C.total(F.col("g"))).alias("energy"), rounded(C.centroid(F.col("g"))).alias("centroid"), F.round(2 * C.centroid(F.col("g"))).cast("long").alias("harmonic"))


@query(f"""WITH {_P} SELECT vec_id, i::BIGINT AS i, round(CASE WHEN i = 0 OR i = n - 1 THEN x ELSE 2 * x + lag(x) OVER w + lead(x) OVER w END, 6) + 0.0 AS x
FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i)""")
def blur(spark, sf_dir):
    return spread(spectra(spark, sf_dir).withColumn("b", C.blur(F.col("x"), 2.0)), "vec_id", "b", "x")


@query(f"""WITH {_P}, z AS (SELECT vec_id, i, n, CASE WHEN i < 3 OR i >= n - 3 THEN 0 ELSE x END AS x FROM p),
t AS (SELECT *, sum(x) OVER (PARTITION BY vec_id) AS t, sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM z)
SELECT vec_id, i::BIGINT AS i, round(CASE WHEN i < 3 OR i >= n - 3 THEN 0 ELSE greatest(0, x - (t - near) * (0.5 / (n - 7))) END, 6) + 0.0 AS x FROM t""")
def contrast_boost(spark, sf_dir):
    return spread(spectra(spark, sf_dir).withColumn("b", C.contrast_boost(F.col("x"), 0.5)), "vec_id", "b", "x")


def _fold(start: str, step: str, put: str, name: str) -> str:
    """SQL of a recurrence over a series: columns at i = 0, at later i (r: before, s: now), and what is put out."""
    return f"""WITH RECURSIVE {_S}, r AS (SELECT user_id, i, x, {start} FROM s WHERE i = 0 UNION ALL
SELECT s.user_id, s.i, s.x, {step} FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT user_id, i::BIGINT AS i, round({put}, 6) + 0.0 AS {name} FROM r"""


@query(_fold("0.0::DOUBLE AS m, x AS y", f"r.m + (s.x - {1 / 3!r}::DOUBLE * r.m - r.m) / s.i, greatest(s.x - {1 / 3!r}::DOUBLE * r.m, 0)", "y", "x"))
def background_subtract(spark, sf_dir):
    return scanned(spark, sf_dir, N.background_subtract(1 / 3), "x")


@query(_fold("greatest(x, (1 - 0.9) * x) AS t", "greatest(s.x, 0.9 * r.t + (1 - 0.9) * s.x)", "CASE WHEN 2 * x < t THEN 0 ELSE x END", "x"))
def post_mask(spark, sf_dir):
    return scanned(spark, sf_dir, N.post_mask(0.9), "x")


@query(_fold("x AS f", "greatest(s.x, 0.996 * r.f + (1 - 0.996) * s.x)", "f", "level"))
def edg_mask(spark, sf_dir):
    return scanned(spark, sf_dir, N.decaying_maximum(0.996), "level")


@query(_fold("0.0::DOUBLE AS p, x AS y", "(1 - (r.p + 1e-5) / (r.p + 1e-5 + 1e-5)) * (r.p + 1e-5), r.y + (r.p + 1e-5) / (r.p + 1e-5 + 1e-5) * (s.x - r.y)", "y", "state"))
def kalman(spark, sf_dir):
    return scanned(spark, sf_dir, N.kalman(1e-5, 1e-5), "state")


@query(f"""WITH RECURSIVE {_P}, b AS (SELECT vec_id, i, n, x AS y FROM p WHERE i = n - 1 UNION ALL SELECT p.vec_id, p.i, p.n, 0.75 * p.x + 0.25 * b.y FROM b JOIN p ON p.vec_id = b.vec_id AND p.i = b.i - 1),
f AS (SELECT vec_id, i, y FROM b WHERE i = 0 UNION ALL SELECT b.vec_id, b.i, 0.75 * b.y + 0.25 * f.y FROM f JOIN b ON b.vec_id = f.vec_id AND b.i = f.i + 1)
SELECT vec_id, i::BIGINT AS i, round(y, 6) + 0.0 AS x FROM f""")
def smooth_spectrum(spark, sf_dir):
    return spread(K.over_frames(spectra(spark, sf_dir), "vec_id", "x", lambda x: K.smooth(x, 0.25)), "vec_id", "x", "x")


@query(f"WITH {_S} SELECT user_id, i::BIGINT AS i, round((x + coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY i), x)) / 2, 6) + 0.0 AS x FROM s")
def two_frame_average(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    s = series(spark, sf_dir)
    return s.select("user_id", F.col("i").cast("long").alias("i"), rounded((F.col("x") + F.coalesce(F.lag("x").over(w), F.col("x"))) / 2).alias("x"))


@query(f"""WITH {_S}, f AS (SELECT user_id, i, x, coalesce(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), x) AS floor FROM s)
SELECT user_id, i::BIGINT AS i, round(floor, 6) + 0.0 AS floor, round(20 * log10(greatest(CASE WHEN x > floor THEN x / greatest(floor, 1e-6) ELSE 0 END, 1e-6)), 6) + 0.0 AS snr FROM f""")
def noise_floor_snr(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-8, -1)
    f = series(spark, sf_dir).withColumn("floor", F.coalesce(F.avg("x").over(w), F.col("x")))
    ratio = F.when(F.col("x") > F.col("floor"), F.col("x") / F.greatest("floor", F.lit(1e-6))).otherwise(0.0)
    return f.select("user_id", F.col("i").cast("long").alias("i"), rounded(F.col("floor")).alias("floor"), rounded(C.to_db(ratio)).alias("snr"))


@query(f"""WITH {_P}, q AS (SELECT a.vec_id, a.i, a.x, b.x AS noise FROM p a JOIN p b ON b.vec_id = a.vec_id - 1 AND a.i = b.i)
SELECT vec_id, round(20 * log10(greatest(coalesce(sum(x) FILTER (x > noise), 0) / greatest(coalesce(sum(noise) FILTER (x > noise), 0), 1e-6), 1e-6)), 6) + 0.0 AS snr FROM q GROUP BY vec_id""")
def spectrum_snr(spark, sf_dir):
    a = spectra(spark, sf_dir)
    b = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("x").alias("noise"))
    return a.join(b, "vec_id").select("vec_id", rounded(C.snr(F.col("x"), F.col("noise"))).alias("snr"))


_LONG = "s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, k) - 1 AS i, abs(v) * 10 AS x FROM (SELECT label, vec_id, UNNEST(range(0, len(embedding))) AS k, UNNEST(embedding)::DOUBLE AS v FROM embeddings))"
_TRIGGER = dict(threshold=6, window=8, edg=0.9, longest=5)


@query(f"""WITH RECURSIVE {_LONG}, r AS (SELECT label, i, []::DOUBLE[] AS ring, x AS noise, NULL::DOUBLE AS ceiling, false AS open, 0 AS held, -120.0::DOUBLE AS best, 0::BIGINT AS begun, 0::BIGINT AS peak, false AS ends FROM s WHERE i = 0 UNION ALL
SELECT label, i, ring, list_sum(ring) / len(ring), ceiling, open, held, best, begun, peak, open AND level < 6 FROM (SELECT *, CASE WHEN open AND level > known THEN i ELSE spot END AS peak, CASE WHEN open THEN greatest(level, known) ELSE known END AS best FROM (
SELECT *, was OR (level >= 6 AND level >= ceiling) AS open, CASE WHEN was THEN since WHEN level >= 6 AND level >= ceiling THEN i ELSE 0 END AS begun, CASE WHEN was OR (level >= 6 AND level >= ceiling) THEN long + 1 ELSE 0 END AS held FROM (
SELECT *, CASE WHEN top IS NULL THEN level ELSE greatest(level, 0.9 * top + (1 - 0.9) * level) END AS ceiling FROM (
SELECT s.label, s.i, CASE WHEN r.open AND NOT r.ends AND r.held > 5 OR NOT r.open OR r.ends THEN list_append(r.ring, s.x)[-8:] ELSE r.ring END AS ring, CASE WHEN s.x > r.noise THEN 20 * log10(greatest(s.x / greatest(r.noise, 1e-6), 1e-6)) ELSE -120.0 END AS level,
r.ceiling AS top, r.open AND NOT r.ends AS was, CASE WHEN r.ends THEN 0 ELSE r.held END AS long, CASE WHEN r.ends THEN -120.0 ELSE r.best END AS known, CASE WHEN r.ends THEN 0 ELSE r.begun END AS since, CASE WHEN r.ends THEN 0 ELSE r.peak END AS spot FROM r JOIN s ON s.label = r.label AND s.i = r.i + 1)))))
SELECT label, begun::BIGINT AS start, i::BIGINT AS stop, peak::BIGINT AS peak, round(best, 6) + 0.0 AS level FROM r WHERE ends""")
def trigger_spans(spark, sf_dir):
    """The detector's trigger over the series of each label, its noise floor frozen while open, in chunks."""
    x = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "v"))
    x = x.select("label", "vec_id", "k", (F.abs(F.col("v").cast("double")) * 10).alias("x"))
    spans = T.trigger_spans(x, ["label"], ["vec_id", "k"], "x", T.Settings(**_TRIGGER))
    return spans.withColumn("level", rounded(F.col("level")))


_ISLANDS = f"""{_S}, a AS (SELECT user_id, i, x, x >= 60 AS loud FROM s), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM a WHERE loud),
v AS (SELECT user_id, min(i) AS start, max(i) AS stop, count(*) AS frames, max(x) AS peak FROM g GROUP BY user_id, island)"""


def islands(spark, sf_dir) -> DataFrame:
    """(user_id, start, stop, frames, peak): runs of values of 60 at least."""
    loud = series(spark, sf_dir).filter("x >= 60")
    loud = loud.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i")))
    return loud.groupBy("user_id", "island").agg(F.min("i").alias("start"), F.max("i").alias("stop"), F.count("*").alias("frames"), F.max("x").alias("peak")).drop("island")


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select("user_id", *[F.col(n).cast("long").alias(n) for n in names])


@query(f"WITH {_ISLANDS} SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop, frames::BIGINT AS frames, round(peak, 6) + 0.0 AS peak FROM v")
def threshold_islands(spark, sf_dir):
    return islands(spark, sf_dir).select("user_id", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "frames")], rounded(F.col("peak")).alias("peak"))


@query(f"WITH {_ISLANDS} SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop, frames::BIGINT AS frames FROM v WHERE frames BETWEEN 2 AND 4")
def duration_filter(spark, sf_dir):
    return _longs(E.duration_filter(islands(spark, sf_dir), F.col("frames"), 2, 4), "start", "stop", "frames")


@query(f"WITH {_ISLANDS} SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop, frames::BIGINT AS frames FROM v WHERE frames > 2")
def area_filter(spark, sf_dir):
    return _longs(E.area_filter(islands(spark, sf_dir), F.col("frames"), 2), "start", "stop", "frames")


@query(f"""WITH {_ISLANDS}, b AS (SELECT *, coalesce(start - lag(stop) OVER w < 2 OR start - lag(stop) OVER w > 4, false) AS bad FROM v WINDOW w AS (PARTITION BY user_id ORDER BY start)),
c AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY user_id ORDER BY start), false) AS follows FROM b) SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop FROM c WHERE NOT bad AND NOT follows""")
def tbe_filter(spark, sf_dir):
    return _longs(E.spacing_filter(islands(spark, sf_dir), F.col("start"), F.col("stop"), 2, 4, ["user_id"], [F.col("start")]), "start", "stop")


@query(f"WITH {_ISLANDS}, b AS (SELECT *, coalesce(start - lag(stop) OVER w < 2 OR start - lag(stop) OVER w > 4, false) AS bad FROM v WINDOW w AS (PARTITION BY user_id ORDER BY start)),\nc AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY user_id ORDER BY start), false) AS follows FROM b) SELECT user_id, start::BIGINT AS start, stop::BIGINT AS stop, frames::BIGINT AS frames FROM c WHERE NOT bad AND NOT follows")
def spaced_in_sql(spark, sf_dir):
    """The spacing filter as a table function."""
    U.register(spark)
    _longs(islands(spark, sf_dir), "start", "stop", "frames").createOrReplaceTempView("echoframe_islands")
    return spark.sql("SELECT * FROM spaced(TABLE(echoframe_islands), keys => 'user_id', start => 'start', stop => 'stop', low => 2, high => 4)")


def _cosines(terms: tuple[float, ...]) -> str:
    """SQL of a cosine-sum window of 64 at j."""
    return " + ".join(f"{(-1) ** k * a!r} * cos({2 * math.pi * k / 63!r} * j)" for k, a in enumerate(terms))


_WINDOWS = {n: WINDOWS[n] for n in ("blackman4", "blackman7")}


@query(f"""WITH h(win, j, h) AS ({' UNION ALL '.join(f"SELECT '{n}', j, {_cosines(t)} FROM (SELECT UNNEST(range(0, 64)) AS j)" for n, t in _WINDOWS.items())}),
{_E}, s AS (SELECT vec_id, i - 32 * f AS j, f, s FROM e, (VALUES (0), (1)) v(f) WHERE i >= 32 * f),
d AS (SELECT vec_id, win, f, k, sum(s * h * cos({_TURN!r} * k * j)) AS re, sum(s * h * sin({_TURN!r} * k * j)) AS im FROM s JOIN h USING (j), (SELECT UNNEST(range(0, 32)) AS k) GROUP BY ALL),
w AS (SELECT win, sum(h) AS total FROM h GROUP BY win)
SELECT vec_id, win, f::BIGINT AS frame_idx, k::BIGINT AS i, round(sqrt(re * re + im * im) / total, 6) + 0.0 AS magnitude FROM d JOIN w USING (win)""")
def window_frames(spark, sf_dir):
    """Frames of both Blackman-Harris windows as a table function over recordings of one vector each."""
    U.register(spark)
    frames(spark, sf_dir).withColumnRenamed("x", "left").createOrReplaceTempView("echoframe_vectors")
    call = lambda n: f"SELECT *, '{n}' AS win FROM spectral_frames(TABLE(echoframe_vectors), size => 64, overlap => 0.5, win => '{n}', compat => 'textbook')"
    f = spark.sql(" UNION ALL ".join(map(call, _WINDOWS)))
    return f.select("vec_id", "win", "frame_idx", F.posexplode("mag").alias("i", "v")).select("vec_id", "win", "frame_idx", F.col("i").cast("long").alias("i"), rounded(F.col("v")).alias("magnitude"))


@query(f"""WITH {_S}, m AS (SELECT *, max(x) OVER w AS hi, min(x) OVER w AS lo, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id))
SELECT user_id, n::BIGINT AS frames, round(max(x) FILTER (i = 0), 6) + 0.0 AS freq_start, round(max(x) FILTER (i = n // 2), 6) + 0.0 AS freq_center, round(max(x) FILTER (i = n - 1), 6) + 0.0 AS freq_end,
round(max(hi), 6) + 0.0 AS freq_max, round(max(lo), 6) + 0.0 AS freq_min, round(max(hi) - max(lo), 6) + 0.0 AS bandwidth,
round(100.0 * min(i) FILTER (x = hi) / n, 6) + 0.0 AS pc_freq_max, round(100.0 * min(i) FILTER (x = lo) / n, 6) + 0.0 AS pc_freq_min FROM m GROUP BY user_id, n""")
def track_features(spark, sf_dir):
    t = tracks(spark, sf_dir)
    x, n = F.col("x"), F.size("x")
    values = dict(
        freq_start=F.get(x, F.lit(0)), freq_center=F.get(x, F.floor(n / 2).cast("int")), freq_end=F.element_at(x, -1), freq_max=F.array_max(x), freq_min=F.array_min(x),
        bandwidth=F.array_max(x) - F.array_min(x), pc_freq_max=C.argmax(x) * 100.0 / n, pc_freq_min=(F.array_position(x, F.array_min(x)) - 1) * 100.0 / n,
    )
    return t.select("user_id", n.cast("long").alias("frames"), *[rounded(v).alias(k) for k, v in values.items()])


@query(f"""WITH {_S}, d AS (SELECT *, abs(x - lag(x) OVER w) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
m AS (SELECT *, round(avg(d) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS mean, max(d) OVER (PARTITION BY user_id) AS most FROM d WHERE i > 0),
c AS (SELECT *, min(mean) FILTER (i > n * 0.6) OVER (PARTITION BY user_id) AS least FROM m),
k AS (SELECT user_id, min(i) FILTER (d = most) AS knee, min(i) FILTER (i > n * 0.6 AND mean = least) AS flat FROM c GROUP BY user_id)
SELECT k.user_id, knee::BIGINT AS knee, flat::BIGINT AS fc_at, round(a.x, 6) + 0.0 AS freq_knee, round(b.x, 6) + 0.0 AS fc, round(a.x - b.x, 6) + 0.0 AS freq_bw_knee_fc, (knee - flat)::BIGINT AS temp_bw_knee_fc
FROM k JOIN s a ON a.user_id = k.user_id AND a.i = k.knee JOIN s b ON b.user_id = k.user_id AND b.i = k.flat""")
def knee_fc(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    s = series(spark, sf_dir)
    d = s.withColumn("d", F.abs(F.col("x") - F.lag("x").over(w))).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).filter("i > 0")
    d = d.withColumn("mean", F.round(F.avg("d").over(w.rowsBetween(-4, 0)), 9))
    late = F.col("i") > F.col("n") * 0.6
    # ties go to the first place
    k = d.groupBy("user_id").agg(F.max(F.struct("d", (-F.col("i")).alias("i"), "x")).alias("knee"), F.min(F.when(late, F.struct("mean", "i", "x"))).alias("flat"))
    k = k.filter("flat is not null")
    knee, flat = -F.col("knee.i"), F.col("flat.i")
    return k.select(
        "user_id", knee.cast("long").alias("knee"), flat.cast("long").alias("fc_at"), rounded(F.col("knee.x")).alias("freq_knee"), rounded(F.col("flat.x")).alias("fc"),
        rounded(F.col("knee.x") - F.col("flat.x")).alias("freq_bw_knee_fc"), (knee - flat).cast("long").alias("temp_bw_knee_fc"),
    )


@query(f"""WITH {_S}, d AS (SELECT *, lead(x) OVER w - x - x + lag(x) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, round(coalesce(sum(abs(d2)), 0), 6) + 0.0 AS smoothness FROM d GROUP BY user_id""")
def smoothness(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    d2 = F.lead("x").over(w) - F.col("x") - F.col("x") + F.lag("x").over(w)
    return series(spark, sf_dir).withColumn("d2", d2).groupBy("user_id").agg(rounded(F.coalesce(F.sum(F.abs("d2")), F.lit(0.0))).alias("smoothness"))


@query(f"""WITH {_S} SELECT user_id, i::BIGINT AS i, round(coalesce(abs(degrees(atan(x - lag(x) OVER w) - atan(lag(x) OVER w - lag(x, 2) OVER w))), 0), 6) + 0.0 AS angle
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def turning_angle(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    m, l = F.lag("x").over(w), F.lag("x", 2).over(w)  # noqa: E741
    angle = F.coalesce(F.abs(F.degrees(F.atan(F.col("x") - m) - F.atan(m - l))), F.lit(0.0))
    return series(spark, sf_dir).select("user_id", F.col("i").cast("long").alias("i"), rounded(angle).alias("angle"))


@query(f"""WITH {_S}, f AS (SELECT user_id, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base, count(*) AS n, max(x) - min(x) AS width FROM s GROUP BY user_id HAVING count(*) > 1),
r AS (SELECT s.user_id, s.i, f.n, s.x - (f.base + f.slope * s.i) AS rest FROM s JOIN f USING (user_id))
SELECT f.user_id, round(f.slope, 6) + 0.0 AS fit_slope, round(f.base, 6) + 0.0 AS fit_base, round(f.width / f.n, 6) + 0.0 AS slope, round(-f.slope * (f.n - 1) / f.n, 6) + 0.0 AS kalman_slope,
round(coalesce(sum(rest) FILTER (rest > 0), 0), 5) + 0.0 AS curve_neg, round(coalesce(sum(rest) FILTER (rest <= 0 AND i < f.n // 2), 0), 5) + 0.0 AS curve_pos_start,
round(coalesce(sum(rest) FILTER (rest <= 0 AND i >= f.n // 2), 0), 5) + 0.0 AS curve_pos_end FROM r JOIN f USING (user_id) GROUP BY f.user_id, f.slope, f.base, f.width, f.n""")
def linear_fit_curves(spark, sf_dir):
    s = series(spark, sf_dir)
    f = s.groupBy("user_id").agg(F.regr_slope("x", "i").alias("b"), F.regr_intercept("x", "i").alias("a"), F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("width")).filter("n > 1")
    rest = F.col("x") - (F.col("a") + F.col("b") * F.col("i"))
    half = F.floor(F.col("n") / 2)
    part = lambda keep: rounded(F.coalesce(F.sum(F.when(keep, rest)), F.lit(0.0)), 5)
    return s.join(f, "user_id").groupBy("user_id", "a", "b", "n", "width").agg(
        part(rest > 0).alias("curve_neg"), part((rest <= 0) & (F.col("i") < half)).alias("curve_pos_start"), part((rest <= 0) & (F.col("i") >= half)).alias("curve_pos_end")
    ).select("user_id", rounded(F.col("b")).alias("fit_slope"), rounded(F.col("a")).alias("fit_base"), rounded(F.col("width") / F.col("n")).alias("slope"),
             rounded(-F.col("b") * (F.col("n") - 1) / F.col("n")).alias("kalman_slope"), "curve_neg", "curve_pos_start", "curve_pos_end")


@query(f"""WITH {_P}, g AS (SELECT UNNEST(range(0, 128)) AS k), q AS (SELECT v.vec_id, g.k, v.n, floor(g.k / 127.0::DOUBLE * (v.n - 1))::BIGINT AS i, g.k / 127.0::DOUBLE * (v.n - 1) - floor(g.k / 127.0::DOUBLE * (v.n - 1)) AS f
FROM (SELECT DISTINCT vec_id, n FROM p) v, g)
SELECT q.vec_id, q.k::BIGINT AS i, round(CASE WHEN q.i > 0 AND q.i < q.n - 2 THEN f * f * f * (3 * b.x - a.x - 3 * c.x + d.x) / 6 + f * f * ((a.x + c.x) / 2 - b.x) + f * (c.x - (2 * a.x + d.x + 3 * b.x) / 6) + b.x
ELSE coalesce(b.x + f * (c.x - b.x), b.x) END, 6) + 0.0 AS x FROM q LEFT JOIN p a ON a.vec_id = q.vec_id AND a.i = q.i - 1 LEFT JOIN p b ON b.vec_id = q.vec_id AND b.i = q.i
LEFT JOIN p c ON c.vec_id = q.vec_id AND c.i = q.i + 1 LEFT JOIN p d ON d.vec_id = q.vec_id AND d.i = q.i + 2""")
def upsample_cubic(spark, sf_dir):
    return spread(K.over_frames(spectra(spark, sf_dir), "vec_id", "x", lambda x: K.up_sample(x, 128)), "vec_id", "x", "x")


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS starting_time
FROM (SELECT event_id, floor(value * 37.0 * 1000)::BIGINT AS ms FROM events)""")
def start_time_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.clock(F.col("value") * 37.0).alias("starting_time"))


@query("""SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension, CASE WHEN regexp_matches(lower(url), '\\.(wav|wac|mp3)$') THEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1))
WHEN regexp_matches(lower(url), '(zc|[0-9]{2}#)$') THEN 'zc' ELSE 'other' END AS format FROM pages""")
def extension_dispatch(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.coalesce(S.file_format(url), F.lit("other")).alias("format"))


@query("""SELECT event_id, trim(split_part(props, ':', 1), ' {"') AS key, try_cast(regexp_extract(props, ':\\s*"?([^",}]*)', 1) AS DOUBLE) AS value FROM events WHERE props IS NOT NULL""")
def kv_metadata(spark, sf_dir):
    """The GUANO reader over lines of `key: value`."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            found = [next(iter(parse_guano(p.strip("{}").replace('"', "")).items()), (None, None)) for p in batch.props]
            yield pd.DataFrame({"event_id": batch.event_id, "key": [k for k, _ in found], "value": [v for _, v in found]})

    lines = table(spark, sf_dir, "events").filter("props is not null").select("event_id", "props").mapInPandas(run, "event_id bigint, key string, value string")
    return lines.withColumn("value", F.col("value").try_cast("double"))


@query("""SELECT event_id, (user_id * 1000)::INT AS rate, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 7 END)::INT AS te, round(value, 3) AS humidity, (value - 50)::DOUBLE AS latitude, -value::DOUBLE AS longitude, event_type AS species FROM events""")
def guano_fields(spark, sf_dir):
    """GUANO texts written from rows, read, and typed."""
    te = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 7).cast("string"))
    number = lambda c: c.cast("double").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("Samplerate: "), F.col("user_id") * 1000), F.concat(F.lit("TE:"), te), F.concat(F.lit("Humidity: "), number(F.round("value", 3))), F.concat(F.lit("Loc Position: "), number(F.col("value") - 50), F.lit(" "), number(-F.col("value"))), F.concat(F.lit("Species: "), F.col("event_type")))
    g = S.guano_columns(S.parsed_guano(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "event_id", "text"))
    return g.select("event_id", F.col("Samplerate").alias("rate"), F.col("TE").alias("te"), F.col("Humidity").alias("humidity"), F.col("Loc Position Lat").alias("latitude"), F.col("Loc Position Lon").alias("longitude"), F.col("guano").getItem("Species").alias("species"))


@query("""SELECT CASE WHEN starts_with(event_type, 'p') THEN 'p' ELSE 'other' END AS label, count(*)::BIGINT AS events, round(avg(value), 6) + 0.0 AS mean_duration FROM events GROUP BY 1""")
def batch_counts_by_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("filename"), F.col("value").alias("duration"))
    return E.batch_counts(e, "p", "p", "other").withColumn("mean_duration", rounded(F.col("mean_duration")))


@query("""SELECT vec_id, (CASE WHEN label % 2 = 0 THEN embedding[1] ELSE embedding[2] END)::DOUBLE AS first FROM embeddings""")
def channel_select(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, 1).otherwise(2).alias("channels"), F.slice("embedding", 1, 1).alias("left"), F.slice("embedding", 2, 1).alias("right"))
    return e.select("vec_id", F.get(E.channel("right"), F.lit(0)).cast("double").alias("first"))


@query(f"WITH {_E} SELECT vec_id, round(sum(s), 6) + 0.0 AS total, count(*)::BIGINT AS samples FROM e WHERE i + 1 BETWEEN greatest(1, floor(0.1 * 64)) AND least(n, ceil(0.7 * 64)) GROUP BY vec_id")
def time_slice(spark, sf_dir):
    r = frames(spark, sf_dir).select("vec_id", F.col("x").alias("left"), F.array().cast("array<double>").alias("right"), F.lit(64).alias("sample_rate"))
    return R.time_slice(r, (0.1, 0.7)).select("vec_id", rounded(C.total(F.col("left"))).alias("total"), F.size("left").cast("long").alias("samples"))


@query("""WITH p AS (SELECT label, vec_id, UNNEST(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, avg(x) + stddev_samp(x) AS t FROM p GROUP BY label)
SELECT vec_id, count(*) FILTER (x < t)::BIGINT AS low, round(sum(CASE WHEN x < t THEN -120 ELSE x END), 5) + 0.0 AS total FROM p JOIN m USING (label) GROUP BY vec_id""")
def below_mean_sd(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("recording_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("mag"))
    f = R.without_background(e)
    return f.select(F.col("frame_idx").alias("vec_id"), F.size(F.filter("mag", lambda v: v == -120)).cast("long").alias("low"), rounded(C.total(F.col("mag")), 5).alias("total"))


@query("""SELECT label::VARCHAR AS recording_id, part::BIGINT AS part, row::BIGINT AS row, count(*)::BIGINT AS n, round(sum(v * (rank + 1)), 4) + 0.0 AS weighted FROM (
SELECT label, vec_id // 100 AS part, 63 - i AS row, v, row_number() OVER (PARTITION BY label, vec_id // 100, i ORDER BY vec_id) - 1 AS rank FROM (SELECT label, vec_id, UNNEST(range(0, 64)) AS i, UNNEST(embedding)::DOUBLE AS v FROM embeddings)) GROUP BY ALL""")
def rotated_frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("recording_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("mag"))
    r = R.rotated(e, 100)
    return r.select("recording_id", "part", "row", F.size("values").cast("long").alias("n"), rounded(C.total(F.transform("values", lambda v, i: v * (i + 1))), 4).alias("weighted"))


@query("""SELECT event_id, round(CASE WHEN value * 2000 < 125000 AND value * 2000 > 16000 THEN value * 2000 END, 6) + 0.0 AS freq_hz, round(event_id / 1e6, 9) AS seconds FROM events WHERE event_id / 1e6 BETWEEN 0.0001 AND 0.9""")
def zc_display(spark, sf_dir):
    dots = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("time_us"), (F.col("value") * 2000.0).alias("freq_hz"))
    return S.zc_display(dots, LPF=125000, HPF=16000, tlim=(0.0001, 0.9)).select("event_id", rounded(F.col("freq_hz")).alias("freq_hz"), F.round("seconds", 9).alias("seconds"))


@query(f"""WITH {_S}, t AS (SELECT user_id, i, (sum(greatest(floor(x * 3), 0)) OVER (PARTITION BY user_id ORDER BY i))::BIGINT AS time_us FROM s),
g AS (SELECT *, time_us - lag(time_us, 2) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM t)
SELECT user_id::VARCHAR AS path, i::BIGINT AS idx, time_us, CASE WHEN gap BETWEEN greatest(48, 4 * 8) AND least(12859, 250 * 8) THEN floor(8 * 1000000 / gap)::DOUBLE END AS freq_hz FROM g""")
def zc_frequency(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i")
    dots = series(spark, sf_dir).withColumn("time_us", F.sum(F.greatest(F.floor(F.col("x") * 3), F.lit(0))).over(w).cast("long"))
    return S.zc_frequency(dots.select(F.col("user_id").cast("string").alias("path"), F.col("i").cast("long").alias("idx"), "time_us"), F.lit(8))


def sample(v):
    """1000 times a value, to the nearest integer. The product is that of doubles, which is exact; a product of floats is rounded, and may reach the half that the value lies below."""
    return F.round(v.cast("double") * 1000).cast("int")


def recordings(spark, sf_dir) -> DataFrame:
    """A recording for each label: its embeddings one after the other, as 16-bit samples at 16 kHz."""
    samples = F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])), sample)
    r = table(spark, sf_dir, "embeddings").groupBy("label").agg(samples.alias("left"))
    return r.select(
        F.concat(F.lit("label"), F.col("label")).alias("recording_id"), F.concat(F.lit("label"), F.col("label"), F.lit(".wav")).alias("filename"), F.lit(16000).alias("sample_rate"), F.lit(16).alias("bit_depth"),
        F.lit(1).alias("channels"), F.lit(1.0).alias("time_exp"), "left", F.array().cast("array<int>").alias("right"), F.create_map(F.lit("Samplerate"), F.lit("16000")).alias("guano"),
    )


@query()
def threshold_detection(spark, sf_dir):
    return E.threshold_detection(recordings(spark, sf_dir), threshold=3, HPF=500, min_dur=0.1, max_dur=1e6, min_TBE=0, max_TBE=1e9, SNR_thr=0, FFT_size=64, NWS=200)


@query()
def blob_detection(spark, sf_dir):
    return E.blob_detection(recordings(spark, sf_dir), HPF=200, min_dur=1, max_dur=1e6, min_area=5, min_TBE=-1e9, max_TBE=1e9, FFT_size=64, bg_substract=1, contrast_boost=1)


def _spectrum_sql(low: int, high: int, value: str) -> str:
    """SQL of hann frames of 64 every 32 samples of recordings(), bins low to high, real parts with the next bin's imaginary part."""
    return f"""WITH s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS t, round(v * 1000)::INT AS x FROM (SELECT label, vec_id, UNNEST(range(0, len(embedding))) AS i, UNNEST(embedding)::DOUBLE AS v FROM embeddings)),
f AS (SELECT label, UNNEST(range(0, (n + 31) // 32)) AS frame FROM (SELECT label, count(*) AS n FROM s GROUP BY label)),
h AS (SELECT sum(0.5 * (1 - cos(j * {2 * math.pi / 63!r}))) AS h FROM (SELECT UNNEST(range(0, 64)) AS j)),
w AS (SELECT label, frame, j, x * (0.5 * (1 - cos(j * {2 * math.pi / 63!r}))) AS y FROM (SELECT f.label, f.frame, s.t - f.frame * 32 AS j, s.x FROM f JOIN (SELECT label, t, x, UNNEST([t // 32, t // 32 - 1]) AS frame FROM s) s ON s.label = f.label AND s.frame = f.frame)),
d AS (SELECT label, frame, k, sum(y * cos({_TURN!r} * k * j)) AS re, sum(y * sin({_TURN!r} * k * j)) AS im FROM w, (SELECT UNNEST(range({low}, {high + 2})) AS k) GROUP BY ALL),
m AS (SELECT a.label, a.frame, a.k, 20 * log10(sqrt(a.re * a.re + CASE WHEN a.k < 31 THEN c.im * c.im ELSE c.re * c.re END) / h.h) AS db FROM d a JOIN d c ON c.label = a.label AND c.frame = a.frame AND c.k = a.k + 1, h)
SELECT 'label' || label AS recording_id, frame::BIGINT AS frame_idx, (frame * 32)::BIGINT AS seek, (k - {low})::BIGINT AS i, round({value}, 4) + 0.0 AS db FROM m"""


def _long_frames(f: DataFrame) -> DataFrame:
    return f.select("recording_id", "frame_idx", "seek", F.posexplode("mag").alias("i", "v")).select("recording_id", "frame_idx", "seek", F.col("i").cast("long").alias("i"), rounded(F.col("v"), 4).alias("db"))


@query(_spectrum_sql(2, 24, "db"))
def fspec(spark, sf_dir):
    return _long_frames(R.fspec(recordings(spark, sf_dir), FFT_size=64, FFT_overlap=0.5, HPF=500, LPF=6000))


@query(_spectrum_sql(0, 31, "greatest(db - max(db) OVER (PARTITION BY label), -120)"))
def spectro(spark, sf_dir):
    return _long_frames(R.spectro(recordings(spark, sf_dir), FFT_size=64, FFT_overlap=0.5))


_RATE, _SIZE = 48000, 256


@query(f"""WITH RECURSIVE {_S}, g AS (SELECT user_id, i, x AS f, abs(x - 50) + 1 AS a, x / 2 AS h, count(*) OVER (PARTITION BY user_id) AS n FROM s),
r AS (SELECT user_id, i, n, f, a, h, 0.0::DOUBLE AS p, (0.0 + 1e-5) / (0.0 + 1e-5 + 1e-5)::DOUBLE AS gain FROM g WHERE i = 0 UNION ALL
SELECT g.user_id, g.i, g.n, r.f + r.gain * (g.f - r.f), r.a + r.gain * (g.a - r.a), r.h + r.gain * (g.h - r.h), (1 - r.gain) * (r.p + 1e-5), ((1 - r.gain) * (r.p + 1e-5) + 1e-5) / ((1 - r.gain) * (r.p + 1e-5) + 2e-5) FROM r JOIN g ON g.user_id = r.user_id AND g.i = r.i + 1),
t AS (SELECT user_id, i, n, f * {_RATE / _SIZE} AS f, a, h FROM r),
d AS (SELECT *, abs(f - lag(f) OVER w) AS d, f - 2 * lag(f) OVER w + lag(f, 2) OVER w AS bend FROM t WINDOW w AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT *, avg(d) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS calm FROM d),
e AS (SELECT user_id, n, min(f) AS low, max(f) AS high, max(a) AS loud, max(d) AS jump, min(calm) FILTER (i > n * 0.6) AS calm, regr_slope(f, i) AS b, regr_intercept(f, i) AS base, sum(h) / sum(a) AS harmonic, coalesce(sum(abs(bend)), 0) AS smoothness FROM c GROUP BY user_id, n),
k AS (SELECT c.user_id, min(i) FILTER (f = high) AS high_at, min(i) FILTER (f = low) AS low_at, min(i) FILTER (a = loud) AS loud_at, coalesce(min(i) FILTER (d = jump AND jump > 0), 0) AS knee, coalesce(min(i) FILTER (c.calm = e.calm AND i > c.n * 0.6 AND e.calm < 128000), 0) AS flat,
sum(greatest(f - base - b * i, 0)) AS neg, sum(least(f - base - b * i, 0)) FILTER (i < c.n // 2) AS pos1, sum(least(f - base - b * i, 0)) FILTER (i >= c.n // 2) AS pos2,
sum(f * CASE WHEN c.n % 2 = 1 THEN CASE WHEN i = c.n // 2 THEN 1 ELSE 0 END WHEN i IN (c.n // 2 - 1, c.n // 2) THEN 0.5625 WHEN i IN (c.n // 2 - 2, c.n // 2 + 1) THEN -0.0625 ELSE 0 END) AS middle FROM c JOIN e USING (user_id) GROUP BY c.user_id),
z AS (SELECT e.*, k.*, e.n * 1000.0 * 32 / {_RATE} AS duration, 1000.0 * 32 / {_RATE} AS frame FROM e JOIN k USING (user_id))
SELECT z.user_id, printf('%02d:%02d:%02d.%03d', z.user_id * 1000 // {_RATE} // 3600, z.user_id * 1000 // {_RATE} // 60 % 60, z.user_id * 1000 // {_RATE} % 60, floor(z.user_id * 1000 * 1000 / {_RATE} + 1e-9)::BIGINT % 1000) AS starting_time, z.user_id * 1000 + 1 AS event_start, z.user_id * 1000 + z.n * 32 AS event_end,
{', '.join(f"round({v}, 4) + 0.0 AS {n}" for n, v in dict(
    duration="duration", freq_max_amp="m.f", freq_max="high", freq_min="low", bandwidth="high - low", freq_start="t0.f", freq_center="tc.f", freq_end="t1.f", freq_knee="tk.f", fc="tf.f", freq_bw_knee_fc="tk.f - tf.f",
    bin_max_amp=f"(10 + z.user_id % 100 + 0.5 / 3) * {_RATE} / 1024", pc_freq_max_amp="100.0 * loud_at / z.n", pc_freq_max="100.0 * high_at / z.n", pc_freq_min="100.0 * low_at / z.n", pc_knee="100.0 * knee / z.n",
    temp_bw_knee_fc="(knee - flat) * frame", slope="(high - low) / duration", kalman_slope="-b * (z.n - 1) / duration", curve_neg="neg", curve_pos_start="pos1", curve_pos_end="pos2",
    mid_offset="base + b * (z.n - 1) / 2 - middle", snr="20 * log10(greatest(3.0 * z.n / greatest(2.0, 1e-6), 1e-6))", hd="20 * log10(greatest(harmonic, 1e-6))", smoothness="smoothness").items())}
FROM z JOIN t t0 ON t0.user_id = z.user_id AND t0.i = 0 JOIN t t1 ON t1.user_id = z.user_id AND t1.i = z.n - 1 JOIN t tc ON tc.user_id = z.user_id AND tc.i = z.n // 2 JOIN t m ON m.user_id = z.user_id AND m.i = loud_at
JOIN t tk ON tk.user_id = z.user_id AND tk.i = knee JOIN t tf ON tf.user_id = z.user_id AND tf.i = flat""")
def event_features(spark, sf_dir):
    """The detector's own feature extraction over events whose tracks are the users' series."""
    import numpy as np
    import pandas as pd

    names = [*detector.FEATURES, "event_start", "event_end"]
    s = detector.Settings(FFT_size=_SIZE, LPF=_RATE / 2)

    def run(batches):
        for batch in batches:
            rows = []
            for user, x in zip(batch.user_id, batch.x):
                x, spectrum = np.asarray(x, dtype=float), np.zeros(512)
                top = 10 + user % 100
                spectrum[top - 1 : top + 2] = 1, 2, 1.5
                e = K.track_event(x, np.abs(x - 50) + 1, x / 2, user * 1000, user * 1000 + len(x) * 32 - 1, 3.0 * len(x), 2.0, spectrum)
                rows.append({"user_id": user} | {k: v for k, v in detector.extract(e, _RATE, s).items() if k in names})
            yield pd.DataFrame(rows, columns=["user_id", *names])

    kinds = {"starting_time": "string", "event_start": "bigint", "event_end": "bigint"}
    f = tracks(spark, sf_dir).mapInPandas(run, "user_id bigint, " + ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
    return f.select("user_id", *[F.col(n) if n in kinds else rounded(F.col(n), 4).alias(n) for n in names])


def _moments_sql(name: str, source: str) -> str:
    """SQL of (vec_id, i, x) -> weighted moments from 1, and Gini impurity."""
    return f"""{name}_w AS (SELECT vec_id, i + 1 AS k, x / sum(x) OVER (PARTITION BY vec_id) AS w FROM {source}), {name}_c AS (SELECT *, sum(w * k) OVER (PARTITION BY vec_id) AS c FROM {name}_w),
{name} AS (SELECT vec_id, min(c) AS centroid, sqrt(sum(w * (k - c) ** 2)) AS sd, sum(w * (k - c) ** 3) AS m3, sum(w * (k - c) ** 4) AS m4, 1 - sum(w * w) AS gini FROM {name}_c GROUP BY vec_id)"""


@query(f"""WITH {_E}, s AS (SELECT vec_id, i // 16 AS c, 15 - i % 16 AS y, abs(s) * 10 AS x FROM e),
o AS (SELECT vec_id, c, min(y) AS top FROM (SELECT *, max(x) OVER (PARTITION BY vec_id, c) AS t FROM s) WHERE x = t GROUP BY ALL),
q AS (SELECT s.vec_id, s.c, s.y, CASE WHEN y > top + 8 OR y BETWEEN 1 AND top - 9 THEN 0 ELSE x END AS x FROM s JOIN o ON o.vec_id = s.vec_id AND o.c = s.c),
v AS (SELECT vec_id, c, floor(sum(x * y) / sum(x) + 0.5)::BIGINT AS peak FROM q WHERE y BETWEEN 1 AND 14 GROUP BY ALL),
power AS (SELECT vec_id, y AS i, sum(CASE WHEN y BETWEEN 1 AND 14 THEN x ELSE 0 END) AS x FROM q GROUP BY ALL), envelope AS (SELECT vec_id, c AS i, sum(x) AS x FROM s GROUP BY ALL),
jumps AS (SELECT a.vec_id, a.peak - b.peak + 16 + q.y - a.peak AS i, sum(q.x) AS x FROM v a JOIN v b ON b.vec_id = a.vec_id AND b.c = a.c - 1 JOIN q ON q.vec_id = a.vec_id AND q.c = a.c AND q.y BETWEEN a.peak - 1 AND a.peak + 1
WHERE a.peak > 0 AND b.peak > 0 AND a.peak - b.peak + 16 + q.y - a.peak BETWEEN 0 AND 31 GROUP BY ALL),
{_moments_sql("freq", "power")}, {_moments_sql("temp", "envelope")}, {_moments_sql("grad", "jumps")},
run AS (SELECT vec_id, i, sum(x) OVER (PARTITION BY vec_id ORDER BY i) AS c, sum(x) OVER (PARTITION BY vec_id) AS t FROM power),
quant AS (SELECT vec_id, {', '.join(f"250.0 * min(i) FILTER (c >= {p} * t) AS q{k}" for k, p in enumerate(_QUANTILES))} FROM run GROUP BY vec_id),
area AS (SELECT vec_id, count(*) AS area FROM q WHERE y BETWEEN 1 AND 14 AND x > 1e-5 GROUP BY vec_id)
SELECT area.vec_id, round(area, 4) + 0.0 AS area, {', '.join(f"round(250 * {p}.centroid, 4) + 0.0 AS {p}_centroid, round(250 * {p}.sd, 4) + 0.0 AS {p}_bandwith, round(250 * {p}.m3 / {p}.sd ** 3, 4) + 0.0 AS {p}_skew, round(250 * ({p}.m4 / {p}.sd ** 4 - 3), 4) + 0.0 AS {p}_kurtosis, round({p}.gini, 4) + 0.0 AS {p}_gini" for p in ("freq", "temp"))},
CASE WHEN grad.sd > 1e-9 THEN round(250 * grad.m3 / grad.sd ** 3, 4) + 0.0 ELSE 0 END AS grad_skew, CASE WHEN grad.sd > 1e-9 THEN round(250 * (grad.m4 / grad.sd ** 4 - 3), 4) + 0.0 ELSE 0 END AS grad_kurtosis, round(250 * grad.centroid, 4) + 0.0 AS grad_centroid, round(250 * grad.sd, 4) + 0.0 AS grad_bandwith, round(grad.gini, 4) + 0.0 AS grad_gini,
round(250 * freq.centroid / greatest(freq.sd, 1), 4) + 0.0 AS q, {', '.join(f"q{k} + 0.0 AS quant_{k}" for k in range(5))}, q4 - q0 + 0.0 AS freq_bw_95_ci, q3 - q1 + 0.0 AS freq_bw_75_ci
FROM area JOIN freq USING (vec_id) JOIN temp USING (vec_id) JOIN grad USING (vec_id) JOIN quant USING (vec_id)""")
def region_features(spark, sf_dir):
    """The region detector's own features over segments of 16 bins and 4 frames."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [{"vec_id": v} | regions.features(np.asarray(x, dtype=float).reshape(4, 16).T, 16000, 64) for v, x in zip(batch.vec_id, batch.x)]
            yield pd.DataFrame(rows)[["vec_id", *names]].rename(columns=dict(zip(names, plain)))

    names = [n for n in regions.FEATURES if n not in ("starting_time", "duration")]
    quant = [n for n in names if n.startswith("quant")]
    plain = [f"quant_{quant.index(n)}" if n in quant else n for n in names]
    f = spectra(spark, sf_dir).mapInPandas(run, "vec_id bigint, " + ", ".join(f"{n} double" for n in plain))
    return f.select("vec_id", *[rounded(F.col(n), 4).alias(n) for n in plain])


@query(f"""WITH RECURSIVE {_P}, d AS (SELECT vec_id, i, x FROM p WHERE x >= 1.8), r AS (SELECT vec_id, i, vec_id * 65536 + i AS m FROM d UNION
SELECT d.vec_id, d.i, r.m FROM r JOIN d ON d.vec_id BETWEEN r.vec_id - 1 AND r.vec_id + 1 AND d.i BETWEEN r.i - 1 AND r.i + 1),
c AS (SELECT vec_id, i, min(m) AS region FROM r GROUP BY ALL)
SELECT region::BIGINT AS region, count(*)::BIGINT AS pixels, round(sum(x), 5) + 0.0 AS total, min(vec_id)::BIGINT AS first_frame, max(vec_id)::BIGINT AS last_frame, min(i)::BIGINT AS low, max(i)::BIGINT AS high FROM c JOIN d USING (vec_id, i) GROUP BY region""")
def pixel_regions(spark, sf_dir):
    """Connected regions of the picture of all frames one after the other, labelled in strips of 64 frames."""
    f = spectra(spark, sf_dir).select(F.lit("all").alias("recording_id"), F.col("vec_id").alias("frame_idx"), F.col("x").alias("mag"))
    return P.pixel_regions(f, 1.8, 64).drop("recording_id").withColumn("total", rounded(F.col("total"), 5))


@query("""WITH s AS (SELECT vec_id // 256 AS file, row_number() OVER (PARTITION BY vec_id // 256 ORDER BY vec_id, k) - 1 AS t, round(v * 1000)::INT AS v FROM (SELECT vec_id, UNNEST(range(0, len(embedding))) AS k, UNNEST(embedding)::DOUBLE AS v FROM embeddings))
SELECT 'f' || file || '.wav' AS filename, greatest(t // 1024 * 1024, 4000)::BIGINT AS sample_offset, count(*)::BIGINT AS n_samples, sum(v)::BIGINT AS total FROM s WHERE t >= 4000 AND t < 12000 GROUP BY ALL""")
def wav_ranges(spark, sf_dir):
    """A quarter to three quarters of a second of WAV files of 256 vectors each, written by the sink and read by byte ranges."""
    D.register(spark)
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("file"), "vec_id", "embedding")
    left = F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])), sample)
    name = F.concat(F.lit("f"), F.col("file"), F.lit(".wav"))
    files = e.groupBy("file").agg(left.alias("left")).select(name.alias("recording_id"), name.alias("filename"), F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"), F.lit(16).alias("bit_depth"), "left", F.array().cast("array<int>").alias("right"))
    folder = new_folder(spark, "wav")
    files.write.format("wav").mode("append").save(folder)
    read = spark.read.format("samples").option("start", 0.25).option("stop", 0.75).option("block", 1024).load(f"{folder}/*.wav")
    return read.select("filename", "sample_offset", F.col("n_samples").cast("long").alias("n_samples"), F.aggregate("left", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("""WITH i AS (SELECT label, vec_id, vec_id * 10 + floor(abs(embedding[1]) * 100)::BIGINT AS a, floor(abs(embedding[2]::DOUBLE) ** 3 * 400000)::BIGINT AS n FROM embeddings)
SELECT x.label, x.vec_id AS event, y.vec_id AS annotation, (least(x.a + x.n, y.a + y.n) - greatest(x.a, y.a))::BIGINT AS shared FROM i x JOIN i y ON x.label = y.label AND x.a <= y.a + y.n AND y.a <= x.a + x.n WHERE x.vec_id % 2 = 0 AND y.vec_id % 7 = 0""")
def overlap_join(spark, sf_dir):
    """Intervals of even vectors with those of every seventh one of the same label that overlap them."""
    value = lambda k: F.get("embedding", F.lit(k)).cast("double")
    i = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") * 10 + F.floor(F.abs(F.get("embedding", F.lit(0))) * 100)).alias("a"), F.floor(F.pow(F.abs(value(1)), 3) * 400000).alias("n"))
    x = i.filter("vec_id % 2 = 0").select("label", F.col("vec_id").alias("event"), F.col("a").alias("xa"), (F.col("a") + F.col("n")).alias("xb"))
    y = i.filter("vec_id % 7 = 0").select("label", F.col("vec_id").alias("annotation"), F.col("a").alias("ya"), (F.col("a") + F.col("n")).alias("yb"))
    pairs = J.overlap_join(x, y, ["label"], ("xa", "xb"), ("ya", "yb"))
    return pairs.select("label", "event", "annotation", (F.least("xb", "yb") - F.greatest("xa", "ya")).alias("shared"))


@query("""SELECT e.vec_id, e.label, r.vec_id AS reading, r.v AS value FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 5 > 0) e
ASOF LEFT JOIN (SELECT vec_id, label, embedding[1]::DOUBLE AS v FROM embeddings WHERE vec_id % 5 = 0) r ON e.label = r.label AND e.vec_id >= r.vec_id""")
def as_of_join(spark, sf_dir):
    """Each vector with the last one of its label whose number five divides."""
    e = table(spark, sf_dir, "embeddings")
    events = e.filter("vec_id % 5 > 0").select("vec_id", "label")
    readings = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("reading"), "label", F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return J.as_of_join(events, readings, ["label"], "vec_id", "reading", ["reading", "value"])


@query("""WITH s AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events),
b AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bout FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS stop, count(*)::BIGINT AS events FROM b GROUP BY user_id, bout""")
def bouts(spark, sf_dir):
    """Bouts of each user's events that lie less than six hours apart."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return J.bouts(e, ["user_id"], "ts", "6 hours").select("user_id", text("start").alias("start"), text("end").alias("stop"), "events")


_WAV = "SELECT 'label' || label AS recording_id, count(*)::BIGINT AS n_samples, sum(v)::BIGINT AS total FROM (SELECT label, round(UNNEST(embedding)::DOUBLE * 1000)::INT AS v FROM embeddings) GROUP BY label"


@query(_WAV)
def wav_round_trip(spark, sf_dir):
    import pandas as pd

    from ..sources.wav import read_wav

    def run(batches):
        for batch in batches:
            decoded = [read_wav(c)["left"] for c in batch.content]
            yield pd.DataFrame(dict(recording_id=batch.recording_id, n_samples=[len(d) for d in decoded], total=[int(d.sum()) for d in decoded]))

    return S.wav_bytes(recordings(spark, sf_dir)).mapInPandas(run, "recording_id string, n_samples bigint, total bigint")
