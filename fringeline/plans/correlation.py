"""Queries on spectra and visibilities, over `embeddings` as four streams of windows of 64 samples.

The queries call the library; the SQL says the same in plain terms, by an explicit Fourier sum over exploded samples.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeline.operators import align, fx, kernels, post, samples
from fringeline.operators.correlate import accumulated, kept, normalised, rounded
from fringeline.plans import views
from fringeline.plans.templates import duckdb_sql
from fringeline.plans.views import FS, N, delayed, streams
from fringeline.sources import results
from fringeline.sources.folders import shared_folder
from fringeline.streaming import correlator as stream_correlator

FREQUENCY = "(1000.25 + 10.5 * sp)"
DELAY = "(0.001 * (sp + 1) + 0.0007 * {t} + 0.00001 * {t} * {t})"

SPECTRUM = """f AS (SELECT acc, w, sp, k, {sums} FROM (SELECT e.*, s.k, 2 * pi() * ((s.k * e.n) % 64) / 64 a FROM e CROSS JOIN {{RANGE 64}} s) GROUP BY acc, w, sp, k)"""
REAL = SPECTRUM.format(sums="sum(x * cos(a)) re, -sum(x * sin(a)) im")
COMPLEX = SPECTRUM.format(sums="sum(xr * cos(a) + xi * sin(a)) re, sum(xi * cos(a) - xr * sin(a)) im")
CROSS = "v AS (SELECT a.acc, a.sp sp0, b.sp sp1, a.k, sum(a.re * b.re + a.im * b.im) re, sum(a.im * b.re - a.re * b.im) im, CAST(count(*) AS BIGINT) n_windows FROM f a JOIN f b ON a.acc = b.acc AND a.w = b.w AND a.k = b.k AND a.sp <= b.sp GROUP BY a.acc, a.sp, b.sp, a.k)"
POWER = "p AS (SELECT acc, sp0 sp, sum(sqrt(re * re + im * im)) p FROM v WHERE sp0 = sp1 GROUP BY acc, sp0)"
NORMAL = "u AS (SELECT v.acc, v.sp0, v.sp1, v.k, v.re / sqrt(nullif(a.p * b.p, 0)) re, v.im / sqrt(nullif(a.p * b.p, 0)) im, n_windows FROM v JOIN p a ON v.acc = a.acc AND v.sp0 = a.sp JOIN p b ON v.acc = b.acc AND v.sp1 = b.sp)"
# A pair's sums, and the powers that normalise it, go over the windows that both of its streams have.
SHARED = CROSS.replace("CAST(count(*)", "sum(a.re * a.re + a.im * a.im) pa, sum(b.re * b.re + b.im * b.im) pb, CAST(count(*)") + ", p AS (SELECT acc, sp0, sp1, sum(pa) pa, sum(pb) pb FROM v GROUP BY acc, sp0, sp1), u AS (SELECT v.acc, v.sp0, v.sp1, v.k, v.re / sqrt(nullif(p.pa * p.pb, 0)) re, v.im / sqrt(nullif(p.pa * p.pb, 0)) im, n_windows FROM v JOIN p ON v.acc = p.acc AND v.sp0 = p.sp0 AND v.sp1 = p.sp1)"
#: Windows that streams lack: one begins late, one loses single windows, one is lost for a whole period.
LOST = "(sp = 1 AND acc = 1) OR (sp = 2 AND w % 25 < 10) OR (sp = 3 AND w % 7 = 3)"
#: Frames that stations lack: one begins late, and one loses single frames and a stretch.
LOST_FRAMES = "(station = 0 AND t % 25 < 6) OR (station = 1 AND (t % 11 = 4 OR (t >= 40 AND t < 60)))"
STREAMS = "WITH e AS (SELECT * FROM {E} q), "
OUT = "acc, sp0, sp1, k, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im, n_windows"
RAW = STREAMS + REAL + ", " + CROSS
T = "((w * 64.0 + n) / 64.0)"
TURNS = {
    "full": f"{FREQUENCY} * {DELAY.format(t=T)}",
    "first": f"{FREQUENCY} * {DELAY.format(t='(w * 64.0 / 64.0)')}",
    "linear": f"{FREQUENCY} * ({DELAY.format(t='(w * 64.0 / 64.0)')} + ({DELAY.format(t='((w * 64.0 + 63) / 64.0)')} - {DELAY.format(t='(w * 64.0 / 64.0)')}) * n / 63.0)",
}


def rotated(mode: str) -> str:
    """Streams with the samples xr, xi after fringe rotation; odd streams are of the lower sideband."""
    turns = TURNS[mode].replace("(1000.25 + 10.5 * sp)", "(1000.25 + 10.5 * sp - 64.0 * (sp % 2))")
    return f"WITH e AS (SELECT acc, w, sp, n, x * cos(2 * pi() * z) xr, x * sin(2 * pi() * z) xi FROM (SELECT *, z0 - floor(z0) z FROM (SELECT q.*, {turns} z0 FROM {{E}} q)))"


FRACTION = f"(SELECT acc, w, sp, k, re, im, CASE WHEN g > 0.5 THEN g - 1 ELSE g END fr FROM (SELECT *, h - floor(h) g FROM (SELECT f.*, {DELAY.format(t='(w * 64.0 / 64.0)')} * 64.0 h FROM f)))"


def fraction_rotated(scale: str) -> str:
    return f"r AS (SELECT acc, w, sp, k, re * cos(2 * pi() * b) - im * sin(2 * pi() * b) re, re * sin(2 * pi() * b) + im * cos(2 * pi() * b) im FROM (SELECT *, {scale} * fr b FROM {FRACTION}))"


SQL = {
    "fx_raw_accumulate": f"{RAW} SELECT {OUT} FROM v",
    "fx_usb_half": f"{RAW} SELECT {OUT} FROM v WHERE k < 32",
    "fx_lsb_half": f"{RAW} SELECT {OUT} FROM v WHERE k >= 32",
    "fx_cross_pol_only": f"{RAW} SELECT {OUT} FROM v WHERE sp0 % 2 <> sp1 % 2",
    "fx_no_autos": f"{RAW} SELECT {OUT} FROM v WHERE sp0 < sp1",
    "fx_per_block": STREAMS + REAL + ", g AS (SELECT *, CAST(floor(w / 5) AS INT) sub FROM f) SELECT a.sub, a.sp sp0, b.sp sp1, a.k, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0 re, round(sum(a.im * b.re - a.re * b.im), 6) + 0.0 im FROM g a JOIN g b ON a.sub = b.sub AND a.w = b.w AND a.k = b.k AND a.sp <= b.sp GROUP BY a.sub, a.sp, b.sp, a.k",
    "normalize_auto_sum": f"{RAW}, {POWER}, {NORMAL} SELECT acc, sp0, round(sum(re), 6) + 0.0 total FROM u WHERE sp0 = sp1 GROUP BY acc, sp0",
    "fringe_rotate": rotated("full") + " SELECT w, sp, n, round(xr, 5) + 0.0 re, round(xi, 5) + 0.0 im FROM e",
    "fringe_rotate_linear": rotated("linear") + " SELECT w, sp, n, round(xr, 5) + 0.0 re, round(xi, 5) + 0.0 im FROM e",
    "fringe_rotate_first": rotated("first") + " SELECT w, sp, n, round(xr, 5) + 0.0 re, round(xi, 5) + 0.0 im FROM e",
    "frac_delay_rotate": STREAMS + REAL + ", " + fraction_rotated("(CASE WHEN sp % 3 = 0 THEN k / 64.0 WHEN sp % 3 = 1 THEN k / 64.0 ELSE -(0.5 - (k - 32) / 64.0) END)") + " SELECT w, sp, k, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im FROM r WHERE sp % 3 = 0 OR (sp % 3 = 1 AND k < 32) OR (sp % 3 = 2 AND k >= 32)",
    "zoom_bands": f"{RAW} SELECT acc, sp0, sp1, k - 16 k, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im FROM v WHERE k >= floor(64 * (104.0 - 100.0) / 16.0) AND k < floor(64 * (104.0 - 100.0) / 16.0) + 16",
    "zoom_average": f"{RAW} SELECT acc, sp0, sp1, CAST(floor(k / 4) AS INT) k, round(avg(re), 6) + 0.0 re, round(avg(im), 6) + 0.0 im FROM v GROUP BY acc, sp0, sp1, CAST(floor(k / 4) AS INT)",
    "vis_compare": f"{RAW}, b AS (SELECT acc, sp0, sp1, k, re * 1.001 re, im + 0.01 im FROM v WHERE k <> 63) SELECT v.acc, CAST(count(*) AS BIGINT) n, CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) missing, round(sum((v.re - b.re) * (v.re - b.re) + (v.im - b.im) * (v.im - b.im)), 4) + 0.0 difference FROM v FULL OUTER JOIN b ON v.acc = b.acc AND v.sp0 = b.sp0 AND v.sp1 = b.sp1 AND v.k = b.k GROUP BY v.acc",
    "swin_sort_order": f"{RAW} SELECT acc, sp0, sp1, CAST(row_number() OVER (ORDER BY acc, 1000000 - abs(floor(sp0 / 2) - floor(sp1 / 2)), floor(sp0 / 2), floor(sp1 / 2), sp0 % 2, sp1 % 2) AS BIGINT) row_nr FROM (SELECT DISTINCT acc, sp0, sp1 FROM v)",
    "visibility_text_roundtrip": f"{RAW} SELECT acc, sp0, sp1, round(sum(re), 4) + 0.0 re, round(sum(im), 4) + 0.0 im, max(n_windows) n_windows FROM v GROUP BY acc, sp0, sp1",
    "fx_visibilities": f"{RAW}, {POWER}, {NORMAL} SELECT {OUT} FROM u",
    "fx_arrow_backend": f"{RAW} SELECT {OUT} FROM v",
    "fx_gaps": f"WITH e AS (SELECT * FROM {{E}} q WHERE NOT ({LOST})), {REAL}, {SHARED} SELECT {OUT} FROM u",
    "fx_triangular": f"WITH e AS (SELECT CAST(floor(w / 125) AS INT) acc, CAST((4 * w + sp) % 64 AS INT) sp, CAST(floor((4 * w + sp) / 64) AS BIGINT) w, n, x FROM {{E}} q), {REAL}, {CROSS} SELECT acc, sp0, sp1, round(sum(re), 5) + 0.0 re, round(sum(im), 5) + 0.0 im, max(n_windows) n_windows FROM v GROUP BY acc, sp0, sp1",
    "fx_hanning": "WITH e AS (SELECT acc, w, sp, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) x FROM {E} q), " + REAL + ", " + CROSS + f" SELECT {OUT} FROM v",
    "fx_full_chain": rotated("full") + ", " + COMPLEX + ", " + fraction_rotated("k / 64.0") + ", " + CROSS.replace("FROM f a JOIN f b", "FROM r a JOIN r b") + f", {POWER}, {NORMAL} SELECT {OUT} FROM u",
}


# The frames of views.py: levels, alignment, and the windows that each stream's delay gives.
FRAME_SAMPLES = """x AS (SELECT *, n - 3 * st - CAST(floor((CAST(floor(n / 64) AS BIGINT) * 64 - 3 * st + 63) / 1600) AS BIGINT) * 1600 m, CAST(floor((CAST(floor(n / 64) AS BIGINT) * 64 - 3 * st + 63) / 1600) AS INT) acc FROM
 (SELECT CAST(vec_id % 2 AS INT) st, CAST(floor(vec_id / 2) AS BIGINT) % 2 pol, CAST(floor(vec_id / 4) AS BIGINT) * 64 + i - 1 n, CASE least(3, greatest(0, floor(CAST(embedding[i] AS DOUBLE) * 4 + 2))) WHEN 0 THEN -3.336 WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 ELSE 3.336 END x
  FROM (SELECT *, unnest(generate_series(1, len(embedding))) i FROM embeddings)))"""
FRAME_SQL = {
    "align_chunks": f"WITH {FRAME_SAMPLES} SELECT acc, st, CAST(pol AS INT) pol, CAST(count(DISTINCT floor(n / 64)) AS BIGINT) chunks, CAST(sum(CASE WHEN m >= 0 THEN 1 ELSE 0 END) AS BIGINT) samples, CAST(sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) AS BIGINT) skipped, CAST(min(CASE WHEN m >= 0 THEN m END) AS BIGINT) first, CAST(max(m) AS BIGINT) last FROM x GROUP BY acc, st, pol",
    "fx_calibration": f"WITH {FRAME_SAMPLES}, b AS (SELECT acc, CAST(2 * st + pol AS INT) sp, (m + 3 * st) % 8 bin, sum(x) s FROM x WHERE m >= 0 GROUP BY acc, st, pol, (m + 3 * st) % 8), t AS (SELECT acc, CAST(2 * st + pol AS INT) sp, CAST(floor(count(*) / 8) AS BIGINT) n_windows FROM x WHERE m >= 0 GROUP BY acc, st, pol) SELECT b.acc, b.sp, k.k, round(sum(s * cos(2 * pi() * ((k.k * bin) % 8) / 8)) / n_windows / 4, 6) + 0.0 re, round(-sum(s * sin(2 * pi() * ((k.k * bin) % 8) / 8)) / n_windows / 4, 6) + 0.0 im, n_windows FROM b JOIN t ON b.acc = t.acc AND b.sp = t.sp CROSS JOIN {{RANGE 8}} k GROUP BY b.acc, b.sp, k.k, n_windows",
    "fx_correlate": f"""WITH {FRAME_SAMPLES},
d AS (SELECT s.k st, w.k w, {views.LATE} * s.k + {views.RATE} * s.k * w.k d, CAST(w.k * 64 + CASE WHEN s.k = 0 THEN 0 ELSE floor(({views.LATE} * s.k + {views.RATE} * s.k * w.k) * 64 + 0.5) - 3 * s.k END AS BIGINT) begin_m FROM {{RANGE 2}} s CROSS JOIN {{RANGE 25}} w),
y AS (SELECT x.acc, CAST(2 * x.st + pol AS INT) sp, x.st, d.w, d.d, m - begin_m i, x FROM x JOIN d ON x.st = d.st AND m >= begin_m AND m < begin_m + 64 WHERE m >= 0),
r AS (SELECT acc, sp, w, d, i, x * cos(2 * pi() * z) xr, x * sin(2 * pi() * z) xi FROM (SELECT *, z0 - floor(z0) z FROM (SELECT y.*, {views.FREQ} * ({views.LATE} * st + {views.RATE} * st * ((y.w * 64 + i) / 64.0)) z0 FROM y))),
g AS (SELECT acc, sp, w, k, d, sum(xr * cos(a) + xi * sin(a)) re, sum(xi * cos(a) - xr * sin(a)) im FROM (SELECT r.*, s.k, 2 * pi() * ((s.k * r.i) % 64) / 64 a FROM r CROSS JOIN {{RANGE 32}} s) GROUP BY acc, sp, w, k, d),
f AS (SELECT acc, sp, w, k, re * cos(b) - im * sin(b) re, re * sin(b) + im * cos(b) im FROM (SELECT *, 2 * pi() * k / 64.0 * CASE WHEN d * 64 - floor(d * 64) > 0.5 THEN d * 64 - floor(d * 64) - 1 ELSE d * 64 - floor(d * 64) END b FROM g)),
{SHARED} SELECT {OUT} FROM u""",
}

# Chunks with gaps and repeats: a session ends where a stream comes again; whole sessions' chunks are numbered on.
FRAME_SQL["sub_periods"] = f"""WITH RECURSIVE {FRAME_SAMPLES},
c0 AS (SELECT acc, CAST(2 * st + pol AS INT) sp, floor(n / 64) frame, min(m) f, count(*) size FROM x WHERE m >= 0 AND NOT ({LOST_FRAMES.replace("station", "st").replace("t %", "floor(n / 64) %").replace("t >=", "floor(n / 64) >=").replace("t <", "floor(n / 64) <")}) GROUP BY acc, st, pol, floor(n / 64)),
c AS (SELECT acc, sp, f, size, 0 again FROM c0 UNION ALL SELECT acc, sp, f, size, 1 FROM c0 WHERE frame % 9 = 0 AND sp < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY acc ORDER BY f, sp, again) p FROM c),
v AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY acc, sp ORDER BY p), 0) last FROM r),
nx AS (SELECT a.acc, a.p, min(b.p) q FROM v a JOIN v b ON a.acc = b.acc AND b.last >= a.p GROUP BY a.acc, a.p),
b AS (SELECT DISTINCT acc, CAST(1 AS BIGINT) start FROM v UNION ALL SELECT b.acc, nx.q FROM b JOIN nx ON b.acc = nx.acc AND b.start = nx.p),
s AS (SELECT v.acc, v.sp, v.f, v.size, v.p, count(b.start) session FROM v JOIN b ON v.acc = b.acc AND b.start <= v.p GROUP BY v.acc, v.sp, v.f, v.size, v.p),
k AS (SELECT acc, session FROM s GROUP BY acc, session HAVING count(*) >= 4),
w AS (SELECT s.acc, s.sp, s.f, s.size, min(s.session) session FROM s JOIN k ON s.acc = k.acc AND s.session = k.session GROUP BY s.acc, s.sp, s.f, s.size)
SELECT acc, sp, CAST(f AS BIGINT) first, CAST(coalesce(sum(size) OVER (PARTITION BY acc, sp ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) place FROM w"""
# Every sample at its place after the slips before it; one at which the delay's whole samples go up is dropped.
SLIP_DELAY = f"({views.LATE} * x.st + {views.RATE} * x.st * {{n}} / 64.0)"
SLIP_WHOLE = f"CASE WHEN x.st = 0 THEN 0 ELSE floor({SLIP_DELAY} * 64 + 0.5) END"
FRAME_SQL["fx_slips_by_sample"] = FRAME_SQL["fx_correlate"][: FRAME_SQL["fx_correlate"].index("d AS (SELECT")] + f"""z AS (SELECT acc, st, pol, x, CAST(m - (whole - 3 * st) AS BIGINT) m2 FROM (SELECT x.*, {SLIP_WHOLE.format(n="m")} whole, {SLIP_WHOLE.format(n="(m - 1)")} before FROM x WHERE m >= 0) WHERE whole <= before),
y AS (SELECT acc, CAST(2 * st + pol AS INT) sp, st, CAST(floor(m2 / 64) AS INT) w, {views.LATE} * st + {views.RATE} * st * CAST(floor(m2 / 64) AS INT) d, m2 % 64 i, x FROM z WHERE m2 >= 0 AND m2 < 1600),
""" + FRAME_SQL["fx_correlate"][FRAME_SQL["fx_correlate"].index("r AS (SELECT acc, sp, w, d, i"):]
FRAME_SQL["stream_correlate"] = FRAME_SQL["fx_correlate"]
FRAME_SQL["fx_correlate_gaps"] = FRAME_SQL["fx_correlate"].replace("WHERE m >= 0)", "WHERE m >= 0 AND NOT (" + LOST_FRAMES.replace("station", "x.st").replace("t %", "floor(n / 64) %").replace("t >=", "floor(n / 64) >=").replace("t <", "floor(n / 64) <") + "))")


def shown(acc: DataFrame) -> DataFrame:
    return acc.select("acc", "sp0", "sp1", "k", rounded("re").alias("re"), rounded("im").alias("im"), F.col("n_windows").cast("long").alias("n_windows"))


def accumulation(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(accumulated(streams(spark, sf_dir), **options))


def half(side: str, first: int) -> Callable[[SparkSession, str], DataFrame]:
    """One half of the band; its coefficients are numbered as in the whole one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        acc = accumulated(streams(spark, sf_dir), transform=lambda x, sp, w: kernels.half_band(np.fft.fft(x, axis=1), side))
        return shown(acc.withColumn("k", F.col("k") + first))

    return run


def fx_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulations of five windows."""
    acc = accumulated(streams(spark, sf_dir).withColumn("acc", F.floor(F.col("w") / 5).cast("int")))
    return shown(acc).select(F.col("acc").alias("sub"), "sp0", "sp1", "k", "re", "im")


def fx_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that begin late, lose windows or are lost for a period; runs of seven windows."""
    return shown(normalised(accumulated(streams(spark, sf_dir).where(f"NOT ({LOST})"), block=7)))


def fx_triangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 64 streams, of which a task holds two groups of eight."""
    v = F.col("w") * 4 + F.col("sp")
    rows = streams(spark, sf_dir).withColumns({"acc": F.floor(F.col("w") / 125).cast("int"), "sp": (v % 64).cast("int"), "w": F.floor(v / 64)})
    acc = accumulated(rows, count=64, streams_per_task=16)
    return acc.groupBy("acc", "sp0", "sp1").agg(rounded(F.sum("re"), 5).alias("re"), rounded(F.sum("im"), 5).alias("im"), F.max("n_windows").alias("n_windows"))


def normalize_auto_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalised(accumulated(streams(spark, sf_dir))).where("sp0 = sp1")
    return out.groupBy("acc", "sp0").agg(rounded(F.sum("re")).alias("total"))


def by_sample(rows: DataFrame, first: int = 0, name: str = "n") -> DataFrame:
    """A row for each sample or coefficient of re and im, rounded."""
    out = rows.select("w", "sp", F.posexplode(F.arrays_zip("re", "im")).alias("i", "v"))
    return out.select("w", "sp", (F.col("i") + first).alias(name), rounded("v.re", 5).alias("re"), rounded("v.im", 5).alias("im"))


def rotation(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: by_sample(samples.rotated(delayed(spark, sf_dir), mode=mode))


def frac_delay_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third stream by its whole band, the upper half and the lower half of it."""
    rows = delayed(spark, sf_dir)
    parts = [by_sample(samples.fraction_rotated(rows.where(F.col("sp") % 3 == i), kind), first, "k") for i, (kind, first) in enumerate((("complex", 0), ("upper", 0), ("lower", 32)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def zoom_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    vis = accumulated(streams(spark, sf_dir))
    channels = spark.createDataFrame([(0, 100.0, 16.0)], "channel int, f double, bw double")
    zooms = spark.createDataFrame([(0, 104.0, 4.0), (1, 114.0, 4.0)], "zoom int, f double, bw double")
    return post.zoom(vis, channels, zooms, N).select("acc", "sp0", "sp1", "k", rounded("re").alias("re"), rounded("im").alias("im"))


def zoom_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = post.averaged(accumulated(streams(spark, sf_dir)), 4)
    return out.select("acc", "sp0", "sp1", "k", rounded("re").alias("re"), rounded("im").alias("im"))


def vis_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result against a changed copy that lacks a coefficient."""
    vis = accumulated(streams(spark, sf_dir))
    other = vis.where("k <> 63").withColumn("re", F.col("re") * 1.001).withColumn("im", F.col("im") + 0.01)
    out = post.difference(vis, other, by=("acc",))
    return out.select("acc", "n", F.col("unmatched").alias("missing"), rounded("difference", 4).alias("difference"))


def swin_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.numbered(results.spectra_rows(accumulated(streams(spark, sf_dir))))
    return out.select("acc", (F.col("st0") * 2 + F.col("pol0")).alias("sp0"), (F.col("st1") * 2 + F.col("pol1")).alias("sp1"), F.col("row_nr").cast("long").alias("row_nr"))


def visibility_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities as lines of text, read again."""
    got = results.read_text_lines(results.text_lines(results.spectra_rows(accumulated(streams(spark, sf_dir))), 1))
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4).alias(c)
    return got.select("acc", (F.col("st0") * 2 + F.col("pol0")).alias("sp0"), (F.col("st1") * 2 + F.col("pol1")).alias("sp1"), total("re"), total("im"), "n_windows")


def fx_visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(normalised(accumulated(streams(spark, sf_dir))))


def fx_full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fringe rotation, Fourier transform, fractional-delay rotation, accumulation and normalisation."""

    def chain(x: np.ndarray, sp: int, w: np.ndarray) -> np.ndarray:
        f, coeffs = 1000.25 + 10.5 * sp, np.array([0.001 * (sp + 1), 0.0007, 0.00001])
        z = np.stack([kernels.fringe_rotate(s, int(i) * N, FS, f, coeffs, lower_complex=bool(sp % 2)) for s, i in zip(x, w, strict=True)])
        fr = kernels.fraction(kernels.delay(coeffs, w * N / FS), FS)
        return kernels.fraction_rotate(np.fft.fft(z, axis=1), fr, "complex", N)

    return shown(normalised(accumulated(streams(spark, sf_dir), transform=chain)))


def frame_chunks(spark: SparkSession, sf_dir: str, lost: str = "false") -> DataFrame:
    good = align.aligned(views.frames(spark, sf_dir).where(f"NOT ({lost})"), views.frame_model(spark), start=0.0, period=views.PERIOD, blocks=views.BLOCKS)
    return align.chunks(good, views.frame_media(spark))


def align_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the frames: how many of each stream and block, their samples, the first and the last one."""
    out = frame_chunks(spark, sf_dir).groupBy(F.col("acc_block").alias("acc"), F.col("station").alias("st"), "pol")
    return out.agg(F.count("*").alias("chunks"), F.sum("n_samples").alias("samples"), F.sum("skip").alias("skipped"), F.min("first_sample").alias("first"), (F.max(F.col("first_sample") + F.col("n_samples")) - 1).alias("last"))


def fx_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlator from frames to visibilities, with a delay that drifts by 80 samples in a block."""
    return shown(fx.correlate(frame_chunks(spark, sf_dir), fft_size=32, period=views.PERIOD))


def fx_correlate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with frames that never came, in runs of seven windows."""
    return shown(fx.correlate(frame_chunks(spark, sf_dir, LOST_FRAMES), fft_size=32, period=views.PERIOD, windows_per_task=7))


def fx_slips_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slips at the samples where delays pass half a sample, in runs of seven windows."""
    return shown(fx.correlate(frame_chunks(spark, sf_dir), fft_size=32, period=views.PERIOD, windows_per_task=7, by_sample=True))


def sub_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that whole sessions keep: their first samples, and where the samples come once gaps are closed; some chunks come twice."""
    chunks = frame_chunks(spark, sf_dir, LOST_FRAMES)
    frame = F.floor((F.col("first_sample") + F.col("n_samples") - 1 + F.col("shift") + F.col("acc_block") * 1600) / 64)
    chunks = chunks.unionByName(chunks.where((frame % 9 == 0) & (F.col("station") == 0)))
    return fx.places(chunks, 4).select(F.col("acc_block").alias("acc"), (F.col("station") * 2 + F.col("pol")).alias("sp"), F.col("first_sample").alias("first"), "place")


def stream_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlator of a stream: the frames come in three steps; a last one, far on, closes all blocks."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = views.frames(spark, sf_dir)
    step = (rows.agg(F.max("t")).first()[0] or 0.0) / 3 + 1
    for k in range(3):
        rows.where(F.floor(F.col("t") / step) == k).write.mode("append").parquet(f"{at}/in")
    rows.limit(1).withColumn("t", F.lit(views.PERIOD * views.BLOCKS - 1)).write.mode("append").parquet(f"{at}/in")
    # three micro-batches or four whatever the size: each one costs every state partition a task
    files = len(spark.read.schema(rows.schema).parquet(f"{at}/in").inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(max(2, -(-files // 3)))).parquet(f"{at}/in")
    good = align.aligned(stream, views.frame_model(spark), start=0.0, period=views.PERIOD, blocks=views.BLOCKS)
    parts = stream_correlator.correlated_stream(align.chunks(good, views.frame_media(spark)), fft_size=32, period=views.PERIOD, start=1.7e9, streams=4, late="100000 seconds")
    stream_correlator.written_stream(parts, f"{at}/out", f"{at}/mark")
    return shown(stream_correlator.visibilities(stream_correlator.read_written(spark, f"{at}/out")))


def fx_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    tones = fx.calibration(frame_chunks(spark, sf_dir))
    return tones.select("acc", "sp", "k", rounded("re").alias("re"), rounded("im").alias("im"), "n_windows")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fx_raw_accumulate": accumulation(block=7),
    "fx_usb_half": half("U", 0),
    "fx_lsb_half": half("L", 32),
    "fx_cross_pol_only": accumulation(keep=lambda a, b: ~kept(a, b, cross_polarisation=False)),
    "fx_no_autos": accumulation(keep=lambda a, b: a < b),
    "fringe_rotate": rotation("full"),
    "fringe_rotate_linear": rotation("linear"),
    "fringe_rotate_first": rotation("first"),
    "fx_arrow_backend": accumulation(),
    "fx_hanning": accumulation(hanning=True),
} | {f.__name__: f for f in (fx_per_block, normalize_auto_sum, frac_delay_rotate, zoom_bands, zoom_average, vis_compare, swin_sort_order, visibility_text_roundtrip, fx_visibilities, fx_full_chain, align_chunks, fx_correlate, fx_correlate_gaps, fx_gaps, fx_triangular, fx_slips_by_sample, sub_periods, stream_correlate, fx_calibration)}
ORACLE_SQL = {name: duckdb_sql(text) for name, text in (SQL | FRAME_SQL).items()}
