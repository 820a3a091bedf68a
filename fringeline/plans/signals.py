"""Queries on samples, times, delays, frames and configuration, over the driver's tables as signal views.

The queries call the library; the SQL says the same in plain terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeline.operators import align, correlate, delays, fx, post, samples
from fringeline.operators.correlate import rounded
from fringeline.plans import views
from fringeline.plans.templates import duckdb_sql
from fringeline.plans.views import events, streams, table, words
from fringeline.sources import experiment, results, vdif
from fringeline.streaming.tumbling import tumbling_power

#: Blocks over 27 days; a delay model in sections of three days, per station.
STATIONS = "(VALUES (0, 'AA', 0.10, 0.001), (1, 'BB', 0.25, -0.002), (2, 'CC', 0.05, 0.0005), (3, 'DD', 0.40, 0.0)) AS st(station, name, c0, c1)"
SECTIONS = "(SELECT CAST(s.k AS BIGINT) section, s.k * 259200.0 start_s, (s.k + 1) * 259200.0 end_s, st.station, 1000.0 + 37.0 * st.station - 3.0 * s.k p0, 0.01 * (st.station + 1) p1, -0.0001 * (s.k + 1) p2, 0.000001 * st.station p3, 0.00000001 p4, -0.0000000001 p5 FROM {RANGE 9} s CROSS JOIN " + STATIONS + ")"
BLOCKS = "(SELECT CAST(c_custkey AS BIGINT) block, CAST(c_custkey * 97777 % 2332800 AS DOUBLE) t FROM {customer})"
STATION_OF = "(SELECT s_nationkey band, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) k FROM {supplier})"
# Degree-5 polynomials moved to an offset d and cut after the square, then in seconds.
SHIFTED = (
    "(SELECT block, t, station, section, t - start_s d, (p0 + (t - start_s) / 86400 * (p1 + (t - start_s) / 86400 * (p2 + (t - start_s) / 86400 * (p3 + (t - start_s) / 86400 * (p4 + (t - start_s) / 86400 * p5))))) / 1e6 q0,"
    " (p1 + (t - start_s) / 86400 * (2 * p2 + (t - start_s) / 86400 * (3 * p3 + (t - start_s) / 86400 * (4 * p4 + (t - start_s) / 86400 * 5 * p5)))) / 1e6 q1,"
    " (p2 + (t - start_s) / 86400 * (3 * p3 + (t - start_s) / 86400 * (6 * p4 + (t - start_s) / 86400 * 10 * p5))) / 1e6 q2"
    f" FROM {BLOCKS} b JOIN {SECTIONS} m ON b.t >= m.start_s AND b.t < m.end_s)"
)
TOTAL = f"(SELECT s.*, (st.c0 + st.c1 * (s.t / 86400.0)) / 1e6 k0, st.c1 / 1e6 k1 FROM {SHIFTED} s JOIN {STATIONS} ON s.station = st.station)"
# The reference station has the largest delay; the last one of equal ones.
REFERENCE = f"(SELECT * FROM (SELECT z.*, row_number() OVER (PARTITION BY block ORDER BY q0 + k0 DESC, station DESC) nr FROM {TOTAL} z) WHERE nr = 1)"
RELATIVE = f"(SELECT a.block, a.station, r.station ref, -(a.q0 - r.q0 + a.k0 - r.k0) d0, -(a.q1 - r.q1 + a.k1 - r.k1) d1, -(a.q2 - r.q2) d2, r.q0 + r.k0 r0, r.q1 + r.k1 r1, r.q2 r2 FROM {TOTAL} a JOIN {REFERENCE} r ON a.block = r.block)"
Q2 = "(SELECT event_id, value, CASE WHEN value <= lo + (hi - lo) / 6 THEN 0 WHEN value <= lo + (hi - lo) / 2 THEN 1 WHEN value <= lo + 5 * (hi - lo) / 6 THEN 2 ELSE 3 END q, lo, hi FROM (SELECT event_id, value, (SELECT min(value) FROM {events}) lo, (SELECT max(value) FROM {events}) hi FROM {events}))"
# Header words made from keys; each fits 32 bits.
WORDS = "(SELECT o_orderkey id, (CAST(o_orderkey AS BIGINT) * 2654435761) & 4294967295 w0, (CAST(o_orderkey AS BIGINT) * 40503 + 12345) & 4294967295 w1, (CAST(o_orderkey AS BIGINT) * 2246822519 + 7) & 4294967295 w2, (CAST(o_orderkey AS BIGINT) * 3266489917 + 99) & 4294967295 w3 FROM {orders})"
FIELDS = "id, CAST((w0 >> 31) & 1 AS INT) invalid, CAST((w0 >> 30) & 1 AS INT) legacy, CAST(w0 & 1073741823 AS BIGINT) epoch_seconds, CAST((w1 >> 24) & 63 AS INT) epoch, CAST(w1 & 16777215 AS INT) frame, CAST((w2 >> 29) & 7 AS INT) version, CAST((w2 >> 24) & 31 AS INT) log2_channels, CAST((w2 & 16777215) * 8 AS BIGINT) frame_bytes, CAST((w3 >> 31) & 1 AS INT) is_complex, CAST(((w3 >> 26) & 31) + 1 AS INT) bits, CAST((w3 >> 16) & 1023 AS INT) thread_id, CAST(w3 & 65535 AS INT) station"
FOLD = "(SELECT CAST(floor(o_orderkey / 1024) AS BIGINT) acc, CAST(o_orderkey % 16 AS INT) bin, sum(o_totalprice) s, count(*) c FROM {orders} GROUP BY floor(o_orderkey / 1024), o_orderkey % 16)"
STREAM = "(SELECT st, ch, CAST(floor(t / 86400) AS BIGINT) block, t, value FROM {V} v0)"
GAPS = "(SELECT o_orderkey id, CAST(o_custkey % 8 AS INT) stream, CAST(floor(o_orderkey / 16) AS BIGINT) * 16 first, o_orderkey % 16 i FROM {orders})"

SQL = {
    # samples
    "quantize_2bit": f"SELECT event_id, CAST(q AS INT) q FROM {Q2}",
    "quantize_1bit": "SELECT event_id, CASE WHEN value <= (lo + hi) / 2 THEN 0 ELSE 1 END q FROM (SELECT event_id, value, (SELECT min(value) FROM {events}) lo, (SELECT max(value) FROM {events}) hi FROM {events})",
    "dequantize_levels": f"SELECT event_id, CASE q WHEN 0 THEN CAST(-3.336 AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) WHEN 2 THEN CAST(1 AS DOUBLE) ELSE CAST(3.336 AS DOUBLE) END x FROM {Q2}",
    "dequantize_uniform": f"SELECT event_id, round(CAST(-1 AS DOUBLE) + q * 2.0 / 3, 6) + 0.0 x FROM {Q2}",
    "complex_pairs": "SELECT a.w, a.sp, CAST(floor(a.n / 2) AS INT) n, round(a.x, 6) + 0.0 re, round(b.x, 6) + 0.0 im FROM {E} a JOIN {E} b ON a.w = b.w AND a.sp = b.sp AND b.n = a.n + 1 WHERE a.n % 2 = 0",
    "pack_bits": "SELECT CAST(floor(o_orderkey / 16) AS BIGINT) word, CAST(sum((CAST(o_custkey AS BIGINT) & 3) << CAST((o_orderkey % 16) * 2 AS INT)) AS BIGINT) packed FROM {orders} GROUP BY floor(o_orderkey / 16)",
    "unpack_bits": f"SELECT id, s.k i, CAST((w0 >> CAST(2 * s.k AS INT)) & 3 AS INT) q FROM {WORDS} w CROSS JOIN {{RANGE 16}} s",
    "corner_turn_real": "SELECT w, sp, n % 4 channel, CAST(floor(n / 4) AS INT) i, round(x, 6) + 0.0 x FROM {E} e",
    "corner_turn_complex": "SELECT w, sp, CAST(floor(n / 2) AS INT) % 4 channel, CAST(floor(n / 8) AS INT) i, n % 2 part, round(x, 6) + 0.0 x FROM {E} e",
    "sample_statistics": "SELECT w, sp, CAST(count(*) AS BIGINT) n, round(min(x), 6) + 0.0 low, round(max(x), 6) + 0.0 high, round(avg(x), 6) + 0.0 mean FROM {E} e GROUP BY w, sp",
    # headers and times
    "vdif_header_decode": f"SELECT {FIELDS} FROM {WORDS} w",
    "vdif_header_encode": f"SELECT id, CAST((CAST(invalid AS BIGINT) << 31) + (CAST(legacy AS BIGINT) << 30) + epoch_seconds AS BIGINT) w0, CAST((CAST(epoch AS BIGINT) << 24) + frame AS BIGINT) w1, CAST((CAST(version AS BIGINT) << 29) + (CAST(log2_channels AS BIGINT) << 24) + CAST(floor(frame_bytes / 8) AS BIGINT) AS BIGINT) w2, CAST((CAST(is_complex AS BIGINT) << 31) + (CAST(bits - 1 AS BIGINT) << 26) + (CAST(thread_id AS BIGINT) << 16) + station AS BIGINT) w3 FROM (SELECT {FIELDS} FROM {WORDS} w)",
    "vdif_epoch_to_mjd": "SELECT o_orderkey, CAST(51544 + floor(epoch / 2) * 365 + floor((floor(epoch / 2) + 3) / 4) + CASE WHEN epoch % 2 = 1 THEN 181 + CASE WHEN CAST(floor(epoch / 2) AS INT) % 4 = 0 THEN 1 ELSE 0 END ELSE 0 END + floor(secs / 86400) AS INT) mjd, CAST(secs % 86400 AS BIGINT) sec FROM (SELECT o_orderkey, CAST(o_custkey % 64 AS INT) epoch, CAST(o_orderkey AS BIGINT) * 977 secs FROM {orders})",
    "date_to_vdif": "SELECT o_orderkey, CAST((year(o_orderdate) - 2000) * 2 + CASE WHEN month(o_orderdate) > 7 OR (month(o_orderdate) = 7 AND day(o_orderdate) > 1) THEN 1 ELSE 0 END AS INT) epoch, {DAYS} * 86400 seconds_2000 FROM {orders}",
    "frame_timestamp": "SELECT o_orderkey, round(CAST(o_orderkey % 86400 AS DOUBLE) + (o_custkey % 1000) * 8000 / 32e6, 6) + 0.0 t FROM {orders}",
    "acc_block_assign": "SELECT event_id, CASE WHEN t >= 86400.0 AND t < 20 * 86400.0 THEN CAST(floor((t - 86400.0) / 21600) AS BIGINT) ELSE -1 END block FROM {V} v",
    "acc_block_counts": "SELECT st, ch, CAST(floor(t / 21600) AS BIGINT) block, CAST(count(*) AS BIGINT) n FROM {V} v WHERE t >= 86400.0 AND t < 20 * 86400.0 GROUP BY st, ch, floor(t / 21600)",
    "frame_rel_pos": "SELECT event_id, CAST(floor(t / 21600) AS BIGINT) block, CAST(floor((t - floor(t / 21600) * 21600) * 4 + 0.5) AS BIGINT) pos FROM {V} v WHERE t >= 0",
    "nearest_epoch": "SELECT event_id, epoch FROM (SELECT event_id, e.k epoch, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - e.k * 259200.0), e.k) nr FROM {V} v CROSS JOIN {RANGE 11} e) WHERE nr = 1",
    "scan_window": "SELECT ch, st, CAST(count(*) AS BIGINT) n, CAST(sum(CASE WHEN event_id % 50 BETWEEN 10 AND 19 THEN 1 ELSE 0 END) AS BIGINT) in_frames FROM {V} v WHERE t >= 172800.0 AND t < 864000.0 GROUP BY ch, st",
    # delays
    "delay_section_range_join": f"SELECT v.event_id, m.section, round(m.p0, 6) + 0.0 p0 FROM {{V}} v JOIN {SECTIONS} m ON v.t >= m.start_s AND v.t < m.end_s AND v.st = m.station",
    "delay_taylor_shift": f"SELECT block, station, section, round(q0 * 1e9, 4) + 0.0 q0, round(q1 * 1e9, 5) + 0.0 q1, round(q2 * 1e9, 8) + 0.0 q2 FROM {SHIFTED} s",
    "delay_ref_station": f"SELECT block, station, round((q0 + k0) * 1e9, 4) + 0.0 delay FROM {REFERENCE} r",
    "delay_relative_poly": f"SELECT block, station, ref, round(d0 * 1e9, 4) + 0.0 d0, round(d1 * 1e9, 4) + 0.0 d1, round(d2 * 1e9, 8) + 0.0 d2 FROM {RELATIVE} r",
    "delay_abe_root": f"SELECT DISTINCT block, round(CASE WHEN abs(r2) < 1e-30 THEN r0 / (1 - r1) ELSE 2 * r0 / ((1 - r1) + sqrt((1 - r1) * (1 - r1) - 4 * r2 * r0)) END * 1e9, 4) + 0.0 root FROM (SELECT block, r0, r1 / 86400.0 r1, r2 / 86400.0 / 86400.0 r2 FROM {RELATIVE} r0)",
    "delay_int_frac": f"SELECT block, station, CAST(CASE WHEN x - floor(x) > 0.5 THEN floor(x) + 1 ELSE floor(x) END AS BIGINT) shift, round(CASE WHEN x - floor(x) > 0.5 THEN x - floor(x) - 1 ELSE x - floor(x) END, 4) + 0.0 frac, 2 * CAST(CASE WHEN x - floor(x) > 0.5 THEN floor(x) + 1 ELSE floor(x) END AS BIGINT) shift_complex FROM (SELECT block, station, d0 * 32e6 x FROM {RELATIVE} r)",
    "frac_slip_detect": "SELECT w, sp, kind, CASE WHEN kind <> 0 THEN CAST(floor((0.5 - a) / (b - a) * 63 + 0.5) AS INT) END slip_at FROM (SELECT *, CASE WHEN slope > 0 AND a < 0.5 AND b >= 0.5 THEN 1 WHEN slope < 0 AND b < 0.5 AND a >= 0.5 THEN -1 ELSE 0 END kind FROM (SELECT w, sp, slope, x0 - floor(x0) a, x1 - floor(x1) b FROM (SELECT w, sp, slope, (0.013 * sp + slope * w) * 64 x0, (0.013 * sp + slope * (w + 63 / 64.0)) * 64 x1 FROM (SELECT DISTINCT w, sp, CASE WHEN sp % 2 = 0 THEN 0.00131 ELSE -0.00173 END slope FROM {E} e))))",
    "frac_slip_apply": "SELECT w, sp, CASE WHEN n > 20 AND sp % 2 = 0 THEN n - 1 WHEN n >= 20 AND sp % 2 = 1 THEN n + 1 ELSE n END n, round(x, 6) + 0.0 x FROM {E} e WHERE NOT (sp % 2 = 0 AND n = 20) UNION ALL SELECT DISTINCT w, sp, 20, 0.0 FROM {E} e WHERE sp % 2 = 1",
    # calibration tones
    "pcal_fold": f"SELECT acc, bin, round(s, 2) + 0.0 s, CAST(c AS BIGINT) n FROM {FOLD} f",
    "pcal_roll": f"SELECT acc, CAST((bin + 3 + acc) % 16 AS INT) bin, round(s, 2) + 0.0 s FROM {FOLD} f",
    "pcal_tones": f"SELECT acc, k.k, round(sum(s * cos(2 * pi() * ((k.k * bin) % 16) / 16)) / sum(c), 4) + 0.0 re, round(-sum(s * sin(2 * pi() * ((k.k * bin) % 16) / 16)) / sum(c), 4) + 0.0 im FROM {FOLD} f CROSS JOIN {{RANGE 16}} k GROUP BY acc, k.k",
    "pcal_tone_positions": "SELECT f.k channel, CAST(floor((base - lo) / (32e6 / 128)) AS INT) + CASE WHEN base < lo THEN CAST(5e6 * 128 / 32e6 AS INT) ELSE 0 END first, CAST(5e6 * 128 / 32e6 AS INT) step FROM (SELECT k, lo, floor(lo / 5e6) * 5e6 base FROM (SELECT CAST(s_suppkey AS INT) k, 3480.4e6 + 32e6 * s_suppkey - 32e6 lo FROM {supplier})) f",
    "pcal_tone_list": "SELECT k channel, CAST(CASE WHEN n = 0 THEN first ELSE first + n * 20 END AS INT) place FROM (SELECT k, CAST(floor((base - lo) / (32e6 / 128)) AS INT) + CASE WHEN base < lo THEN 20 ELSE 0 END first FROM (SELECT k, lo, floor(lo / 5e6) * 5e6 base FROM (SELECT CAST(s_suppkey AS INT) k, 3480.4e6 + 32e6 * s_suppkey - 32e6 lo FROM {supplier})) f) CROSS JOIN (SELECT k n FROM {RANGE 7} r7) WHERE first + n * 20 < 140 AND first + n * 20 <= 128 UNION ALL SELECT k channel, -12800 place FROM (SELECT k, first FROM (SELECT k, CAST(floor((base - lo) / (32e6 / 128)) AS INT) + CASE WHEN base < lo THEN 20 ELSE 0 END first FROM (SELECT k, lo, floor(lo / 5e6) * 5e6 base FROM (SELECT CAST(s_suppkey AS INT) k, 3480.4e6 + 32e6 * s_suppkey - 32e6 lo FROM {supplier})) f)) WHERE first + 120 > 128 AND first + 120 < 140",
    "pcal_report_lines": "SELECT acc, 'PCAL_60310_000000_S' || CAST(sp AS {STRING}) file, 'S' || CAST(sp AS {STRING}) || ' ' || {FIXED7} || {LASTS} || CAST(sp AS {STRING}) || ' 1 2 95 X ' || {TONE1} || ' 90 X ' || {TONE0} line FROM (SELECT acc, sp, sum(CASE WHEN n = 0 THEN x END) a0, sum(CASE WHEN n = 1 THEN x END) a1, sum(CASE WHEN n = 2 THEN x END) b0, sum(CASE WHEN n = 3 THEN x END) b1 FROM {E} e WHERE w % 25 = 0 GROUP BY acc, sp)",
    # baselines, lookups
    "fx_scaling_partition": f"SELECT band, s0, s1, task, CAST(count(*) OVER (PARTITION BY band, task) AS BIGINT) task_pairs FROM (SELECT a.band, a.k s0, b.k s1, CASE WHEN (a.k + b.k) % 2 = 0 THEN a.k ELSE b.k END task FROM {STATION_OF} a JOIN {STATION_OF} b ON a.band = b.band AND a.k <= b.k)",
    "corr_pairs": f"SELECT a.band, a.k s0, b.k s1, CASE WHEN floor(a.k / 2) = floor(b.k / 2) THEN 'auto' ELSE 'cross' END kind, CASE WHEN a.k % 2 = b.k % 2 THEN 'same' ELSE 'mixed' END pols FROM {STATION_OF} a JOIN {STATION_OF} b ON a.band = b.band AND a.k <= b.k",
    "swin_baseline_ids": f"SELECT a.band, a.k st0, b.k st1, 256 * (a.k + 1) + b.k + 1 baseline, CAST(floor((256 * (a.k + 1) + b.k + 1) / 256) AS INT) - 1 back0, (256 * (a.k + 1) + b.k + 1) % 256 - 1 back1 FROM {STATION_OF} a JOIN {STATION_OF} b ON a.band = b.band AND a.k <= b.k",
    "media_lookup_join": "SELECT s.s_suppkey, n.n_name, r.r_name FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "missing_delay_antijoin": f"SELECT v.st, v.ch, CAST(count(*) AS BIGINT) n FROM {{V}} v WHERE NOT EXISTS (SELECT 1 FROM {SECTIONS} m WHERE v.t >= m.start_s AND v.t < m.end_s AND v.st = m.station) GROUP BY v.st, v.ch",
    "zoom_containment_join": "SELECT p_partkey zoom, s_suppkey channel FROM (SELECT p_partkey, 96e6 + (p_partkey * 7919 % 4000) * 1e5 f, (p_size % 4 + 1) * 1e6 bw FROM {part}) z JOIN (SELECT s_suppkey, 96e6 + 32e6 * (s_suppkey % 10) f, 32e6 bw FROM {supplier}) c ON z.f >= c.f AND z.f + z.bw <= c.f + c.bw",
    # streams
    "stitch_gap_detect": f"SELECT stream, first, before_end, first - before_end gap FROM (SELECT stream, first, lag(first + 16) OVER (PARTITION BY stream ORDER BY first) before_end FROM (SELECT DISTINCT stream, first FROM {GAPS} g)) WHERE before_end IS NOT NULL AND first > before_end",
    "cut_fft_multiple": f"SELECT block, ch, CAST(min(n) AS BIGINT) shortest, CAST(max(n) AS BIGINT) longest, CAST(floor(min(n) / 8) * 8 AS BIGINT) used FROM (SELECT block, ch, st, count(*) n FROM {STREAM} s GROUP BY block, ch, st) GROUP BY block, ch",
    "stream_stats": "SELECT CAST(floor(o_orderkey / 1024) AS INT) block, CAST(o_custkey % 8 AS INT) stream, CAST(count(*) AS BIGINT) n_chunks, CAST(16 * count(*) AS BIGINT) n_total, CAST(16 * max(o_orderkey % 1024) + 16 AS BIGINT) last_sample, CAST(16 * max(o_orderkey % 1024) + 16 - 16 * min(o_orderkey % 1024) - 16 * count(*) AS BIGINT) n_missing FROM {orders} GROUP BY floor(o_orderkey / 1024), o_custkey % 8",
    "dismissed_blocks": "SELECT CAST(floor(t / 3600) AS INT) block, ch, CAST(count(DISTINCT st) AS BIGINT) streams FROM {V} v GROUP BY floor(t / 3600), ch HAVING count(DISTINCT st) < 4",
    "file_profile": f"SELECT CAST(count(*) AS BIGINT) frames, CAST(count(DISTINCT station) AS BIGINT) stations, CAST(count(DISTINCT thread_id) AS BIGINT) threads, CAST(count(DISTINCT bits) AS BIGINT) bits, CAST(sum(frame_bytes) AS BIGINT) bytes, CAST(sum(invalid) AS BIGINT) invalid FROM (SELECT {FIELDS} FROM {WORDS} w)",
    "frames_per_second": "SELECT CAST(floor(us / 1000000 / 3600) AS BIGINT) period, CAST(max(event_id % 1000) + 1 AS INT) frames FROM {V} v GROUP BY floor(us / 1000000 / 3600)",
    "frame_runs": "SELECT user_id, CAST(min(nr) AS BIGINT) first_nr, CAST(max(nr) AS BIGINT) last_nr, CAST(count(*) AS BIGINT) n FROM (SELECT user_id, nr, nr - row_number() OVER (PARTITION BY user_id ORDER BY nr) island FROM (SELECT DISTINCT user_id, CAST(floor(t / 86400) AS BIGINT) nr FROM {V} v)) GROUP BY user_id, island",
    "union_streams": "SELECT src, CAST(count(*) AS BIGINT) n, round(sum(x), 2) + 0.0 total FROM (SELECT 'o' src, o_totalprice x FROM {orders} UNION ALL SELECT 'v' src, value x FROM {events}) GROUP BY src",
    "header_listing_limit": f"SELECT {FIELDS} FROM {WORDS} w ORDER BY id LIMIT 25 OFFSET 10",
    "result_listing": "SELECT ch, st, CAST(event_id AS BIGINT) event_id FROM {V} v WHERE ch LIKE 'p%'",
    "bulk_quantity_blocks": "SELECT CAST(floor(l_orderkey / 4096) AS BIGINT) acc, CAST(l_linenumber AS INT) channel, CAST(count(*) AS BIGINT) n, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 total FROM {lineitem} GROUP BY floor(l_orderkey / 4096), l_linenumber",
}


def signal(name: str):
    """Registers a query that is made of the library's parts."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        return f

    return keep


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def levels_of(bits: int) -> Callable[[SparkSession, str], DataFrame]:
    """Events with the quantised value of each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = samples.with_range(events(spark, sf_dir).select("event_id", "value"), "value")
        return rows.select("event_id", samples.quantised(F.col("value"), F.col("low"), F.col("high"), bits).cast("int").alias("q"))

    return run


QUERIES["quantize_2bit"], QUERIES["quantize_1bit"] = levels_of(2), levels_of(1)


@signal("dequantize_levels")
def dequantize_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.dequantised(levels_of(2)(spark, sf_dir), 2).select("event_id", "x")


@signal("dequantize_uniform")
def dequantize_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.dequantised(levels_of(2)(spark, sf_dir), 2, even=True).select("event_id", rounded("x").alias("x"))


@signal("complex_pairs")
def complex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.paired(streams(spark, sf_dir)).select("w", "sp", F.posexplode(F.arrays_zip("re", "im")).alias("n", "v"))
    return rows.select("w", "sp", "n", rounded("v.re").alias("re"), rounded("v.im").alias("im"))


@signal("pack_bits")
def pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen components of two bits a word; a place without an order is 0."""
    q = F.col("o_custkey").cast("int").bitwiseAND(3)
    parts = [F.coalesce(F.max(F.when(F.col("o_orderkey") % 16 == i, q)), F.lit(0)).alias(f"q{i}") for i in range(16)]
    rows = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 16).alias("word")).agg(*parts)
    out = samples.packed(rows.select("word", F.array(*(f"q{i}" for i in range(16))).alias("q")), 2)
    return out.select("word", F.conv(F.hex(from_last("packed")), 16, 10).cast("long").alias("packed"))


def from_last(c: str) -> Column:
    """The four bytes of a word, from the last one on."""
    return F.concat(*(F.substring(c, i, 1) for i in (4, 3, 2, 1)))


@signal("unpack_bits")
def unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.unpacked(samples.little_endian(words(spark, sf_dir).select("id", "w0"), "w0"), 2)
    return rows.select("id", F.posexplode("q").alias("i", "q"))


def corner_turn(is_complex: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Windows as four channels, and their samples."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = samples.turned(streams(spark, sf_dir), 4, is_complex).select("w", "sp", F.posexplode("turned").alias("channel", "v"))
        rows = rows.select("w", "sp", "channel", F.posexplode("v").alias("i", "x"))
        place = [F.floor(F.col("i") / 2).cast("int").alias("i"), (F.col("i") % 2).alias("part")] if is_complex else ["i"]
        return rows.select("w", "sp", "channel", *place, rounded("x").alias("x"))

    return run


QUERIES["corner_turn_real"], QUERIES["corner_turn_complex"] = corner_turn(False), corner_turn(True)


@signal("sample_statistics")
def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.statistics(streams(spark, sf_dir)).select("w", "sp", "n", *(rounded(c).alias(c) for c in ("low", "high", "mean")))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.headers(words(spark, sf_dir), ("w0", "w1", "w2", "w3"))


def named_fields(rows: DataFrame) -> DataFrame:
    int_ = lambda c, name=None: F.col(c).cast("int").alias(name or c)
    return rows.select("id", int_("invalid"), int_("legacy"), F.col("seconds").alias("epoch_seconds"), int_("epoch"), int_("frame_num", "frame"), int_("version"), int_("log2_channels"), (F.col("frame_words") * 8).alias("frame_bytes"), int_("is_complex"), (F.col("bits_less_one") + 1).cast("int").alias("bits"), int_("thread_id"), int_("station_code", "station"))


@signal("vdif_header_decode")
def vdif_header_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_fields(header_fields(spark, sf_dir))


@signal("vdif_header_encode")
def vdif_header_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.header_words(header_fields(spark, sf_dir).drop("w0", "w1", "w2", "w3")).select("id", "w0", "w1", "w2", "w3")


@signal("vdif_epoch_to_mjd")
def vdif_epoch_to_mjd(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = F.col("o_orderkey").cast("long") * 977
    return table(spark, sf_dir, "orders").select("o_orderkey", vdif.mjd_of((F.col("o_custkey") % 64).cast("int"), secs).alias("mjd"), (secs % 86400).alias("sec"))


@signal("date_to_vdif")
def date_to_vdif(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch, seconds = vdif.half_year(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", epoch.alias("epoch"), seconds.alias("seconds_2000"))


@signal("frame_timestamp")
def frame_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8000 samples of two bits."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 86400).cast("long").alias("seconds"), (F.col("o_custkey") % 1000).alias("frame_num"), F.lit(48).alias("epoch"), F.lit(2032).alias("frame_bytes"), F.lit(2).alias("bits"), F.lit(0).alias("log2_channels"), F.lit(False).alias("is_complex"))
    return vdif.with_time(rows, 32e6).select("o_orderkey", rounded("t").alias("t"))


@signal("acc_block_assign")
def acc_block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = align.block_of(F.col("t"), 86400.0, 21600.0, 76)
    return events(spark, sf_dir).select("event_id", F.coalesce(block, F.lit(-1)).cast("long").alias("block"))


@signal("acc_block_counts")
def acc_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("block", align.block_of(F.col("t"), 86400.0, 21600.0, 76)).where("block IS NOT NULL")
    return rows.groupBy("st", "ch", (F.col("block") + 4).cast("long").alias("block")).agg(F.count("*").alias("n"))


@signal("frame_rel_pos")
def frame_rel_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.selected(events(spark, sf_dir), start=0.0)
    return rows.select("event_id", F.floor(F.col("t") / 21600).alias("block"), align.place_in_block(F.col("t"), 0.0, 21600.0, 4).alias("pos"))


@signal("nearest_epoch")
def nearest_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nearest_epoch(events(spark, sf_dir).select("event_id", "t"), "t", [k * views.SECTION for k in range(11)]).select("event_id", "epoch")


@signal("scan_window")
def scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.selected(events(spark, sf_dir), start=172800.0, end=864000.0)
    return rows.groupBy("ch", "st").agg(F.count("*").alias("n"), F.count_if(align.in_numbers(F.col("event_id") % 50, 10, 10)).alias("in_frames"))


@signal("delay_section_range_join")
def delay_section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delays.in_sections(views.placed_events(spark, sf_dir), views.sections(spark))
    return rows.select("event_id", "section", rounded(F.get("coeffs", F.lit(0)) * 1e6).alias("p0"))


@signal("missing_delay_antijoin")
def missing_delay_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delays.without_section(views.placed_events(spark, sf_dir), views.sections(spark))
    return rows.groupBy(F.col("station").alias("st"), "ch").agg(F.count("*").alias("n"))


@signal("delay_asof")
def delay_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the last delay section of their station that began before them, sections that have ended included."""
    rows = delays.asof(views.placed_events(spark, sf_dir), views.sections(spark).select("station", "section", "start_s"), ("station",), "t", "start_s")
    return rows.select("event_id", "section")


def polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delays.block_polynomials(views.blocks(spark, sf_dir), views.sections(spark), views.clocks(spark))


def nano(c: str, days: int, digits: int) -> Column:
    """Nanoseconds, per day to a power."""
    return rounded(F.expr(c) * 86400.0**days * 1e9, digits)


@signal("delay_taylor_shift")
def delay_taylor_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.floor(F.col("block") * 97777 % 2332800 / 259200).alias("section")
    return polynomials(spark, sf_dir).select("block", "station", section, nano("q0", 0, 4).alias("q0"), nano("q1", 1, 5).alias("q1"), nano("q2", 2, 8).alias("q2"))


@signal("delay_ref_station")
def delay_ref_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delays.relative(polynomials(spark, sf_dir)).where("station = ref").select("block", "station", nano("q0 + k0", 0, 4).alias("delay"))


@signal("delay_relative_poly")
def delay_relative_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delays.relative(polynomials(spark, sf_dir)).select("block", "station", "ref", nano("d0", 0, 4).alias("d0"), nano("d1", 1, 4).alias("d1"), nano("d2", 2, 8).alias("d2"))


@signal("delay_abe_root")
def delay_abe_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delays.relative(polynomials(spark, sf_dir)).select("block", nano("f", 0, 4).alias("root")).distinct()


@signal("delay_int_frac")
def delay_int_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift, frac = delays.shift_and_fraction(F.col("d0"), F.lit(32e6), F.lit(False))
    twice, _ = delays.shift_and_fraction(F.col("d0"), F.lit(32e6), F.lit(True))
    return delays.relative(polynomials(spark, sf_dir)).select("block", "station", shift.alias("shift"), rounded(frac, 4).alias("frac"), twice.alias("shift_complex"))


@signal("frac_slip_detect")
def frac_slip_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams(spark, sf_dir).withColumn("slope", F.when(F.col("sp") % 2 == 0, 0.00131).otherwise(-0.00173)).withColumn("fs", F.lit(64.0))
    delay = lambda t: 0.013 * F.col("sp") + F.col("slope") * t
    rows = rows.withColumn("d_start", delay(F.col("w"))).withColumn("d_end", delay(F.col("w") + 63 / 64.0))
    return samples.slips(rows, 64).select("w", "sp", "kind", "slip_at")


@signal("frac_slip_apply")
def frac_slip_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even streams drop sample 20, odd ones get one there."""
    rows = streams(spark, sf_dir).withColumn("kind", F.when(F.col("sp") % 2 == 0, 1).otherwise(-1)).withColumn("slip_at", F.lit(20))
    return samples.slipped(rows).select("w", "sp", F.posexplode("samples").alias("n", "x")).select("w", "sp", "n", rounded("x").alias("x"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as samples in runs of up to 256, numbered by their keys."""
    rows = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1024).alias("acc"), F.floor(F.col("o_orderkey") / 256).alias("run"))
    v = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    return rows.agg(v.alias("v")).select("acc", F.get("v", F.lit(0))["o_orderkey"].alias("first_sample"), F.col("v.o_totalprice").alias("samples"))


@signal("pcal_fold")
def pcal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.folded(order_runs(spark, sf_dir), 16, ("acc",)).where("n > 0").select("acc", "bin", rounded("s", 2).alias("s"), "n")


@signal("pcal_roll")
def pcal_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.folded(order_runs(spark, sf_dir), 16, ("acc",), shift="3 + acc").where("n > 0").select("acc", "bin", rounded("s", 2).alias("s"))


@signal("pcal_tones")
def pcal_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.toned(fx.folded(order_runs(spark, sf_dir), 16, ("acc",)), ("acc",)).select("acc", "k", rounded("re", 4).alias("re"), rounded("im", 4).alias("im"))


def tone_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lit(3480.4e6) + F.col("s_suppkey") * 32e6 - 32e6
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("channel"), low.alias("low"), F.lit(5e6).alias("f_pcal"), F.lit(32e6).alias("bw"), F.lit(128).alias("n"))


@signal("pcal_tone_positions")
def pcal_tone_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, step = post.tone_start(F.col("low"), F.col("f_pcal"), F.col("bw"), F.col("n"))
    return tone_bands(spark, sf_dir).select("channel", first.alias("first"), step.alias("step"))


@signal("pcal_tone_list")
def pcal_tone_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tone_bands(spark, sf_dir).select("channel", F.explode(post.tone_positions(F.col("low"), F.col("f_pcal"), F.col("bw"), F.col("n"))).alias("place"))


@signal("pcal_report_lines")
def pcal_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of calibration files, of two tones a band: the first samples of each period's first window stand for them."""
    rows = streams(spark, sf_dir).where("w % 25 = 0")
    at = lambda i: F.get("samples", F.lit(i))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), at(2 * i).alias("re"), at(2 * i + 1).alias("im")) for i, k in ((0, 0), (1, 5)))))
    tones = rows.select("acc", (F.col("sp") * 2).alias("sp"), "channel", pairs.alias("v")).select("acc", "sp", "channel", "v.*")
    bands = spark.createDataFrame([(0, 100e6, 10e6, 5e6, 10)], "channel int, f double, bw double, f_pcal double, n int")
    stations = spark.createDataFrame([(i, f"S{i}") for i in range(4)], "station int, name string")
    records = results.tone_records(tones, bands).where(F.col("text") != results.INVALID_TONE)
    lines = results.calibration_lines(records, stations, mjd=60310, start=0.0, period=1.0, n_bands=1, n_tones=2)
    return lines.select("acc", F.concat(F.lit(results.calibration_name(60310, 0.0, "")), F.col("name")).alias("file"), F.col("value").alias("line"))


@signal("fx_scaling_partition")
def fx_scaling_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stations of each band in pairs, the task that forms each, and how many pairs that task has."""
    rows = correlate.pairs_of(views.stations(spark, sf_dir), ("band",)).withColumn("task", correlate.task_of(F.col("s0"), F.col("s1")))
    return rows.withColumn("task_pairs", F.count("*").over(Window.partitionBy("band", "task"))).select("band", "s0", "s1", "task", "task_pairs")


@signal("corr_pairs")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.with_kind(correlate.pairs_of(views.stations(spark, sf_dir), ("band",)))


@signal("swin_baseline_ids")
def swin_baseline_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = correlate.pairs_of(views.stations(spark, sf_dir), ("band",))
    rows = pairs.select("band", F.col("s0").alias("st0"), F.col("s1").alias("st1")).withColumn("baseline", results.baseline_number(F.col("st0"), F.col("st1")))
    a, b = results.stations_of(F.col("baseline"))
    return rows.select("band", "st0", "st1", "baseline", a.alias("back0"), b.alias("back1"))


@signal("media_lookup_join")
def media_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows described by one dimension table and then by another, as frames are by media and stations."""
    rows = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    one = experiment.described(rows, table(spark, sf_dir, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return experiment.described(one, table(spark, sf_dir, "region"), "r_regionkey").select("s_suppkey", "n_name", "r_name")


@signal("zoom_containment_join")
def zoom_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of the lower sideband, named by their upper edges."""
    zooms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("zoom"), (96e6 + F.col("p_partkey") * 7919 % 4000 * 1e5).alias("f"), ((F.col("p_size") % 4 + 1) * 1e6).alias("bw"))
    channels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("channel"), (96e6 + 32e6 * (F.col("s_suppkey") % 10 + 1)).alias("f"), F.lit(32e6).alias("bw"), F.lit("L").alias("sideband"))
    return post.contained(zooms, channels).select("zoom", "channel")


@signal("stitch_gap_detect")
def stitch_gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).cast("int").alias("stream"), (F.floor(F.col("o_orderkey") / 16) * 16).alias("first_sample"), F.lit(16).alias("n_samples")).distinct()
    return fx.gaps(chunks, ("stream",))


@signal("cut_fft_multiple")
def cut_fft_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).alias("block"), "ch", "st").agg(F.count("*").alias("n"))
    return fx.usable(rows, ("block", "ch"), 8)


@signal("stream_stats")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of 16 samples, in blocks of 1024 chunks."""
    k = F.col("o_orderkey")
    chunks = table(spark, sf_dir, "orders").select(F.floor(k / 1024).cast("int").alias("acc_block"), F.lit(0).alias("channel"), (F.col("o_custkey") % 8).cast("int").alias("station"), F.lit(0).alias("pol"), (k % 1024 * 16).alias("first_sample"), F.lit(16).alias("n_samples"))
    return fx.stream_statistics(chunks).select(F.col("acc_block").alias("block"), F.col("station").alias("stream"), "n_chunks", "n_total", "last_sample", "n_missing")


@signal("dismissed_blocks")
def dismissed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = events(spark, sf_dir).select(F.floor(F.col("t") / 3600).cast("int").alias("acc_block"), F.col("ch").alias("channel"), F.col("st").alias("station"), F.lit(0).alias("pol"))
    return fx.dismissed(chunks, 4).select(F.col("acc_block").alias("block"), F.col("channel").alias("ch"), "streams")


@signal("file_profile")
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header_fields(spark, sf_dir)
    frames = h.select((F.col("frame_words") * 8).alias("frame_bytes"), "station_code", "thread_id", (F.col("bits_less_one") + 1).alias("bits"), "seconds", "frame_num", F.lit(True).alias("complete"), (F.col("invalid") > 0).alias("invalid"))
    return vdif.file_summary(frames, ()).select("frames", "stations", "threads", "bits", "bytes", "invalid")


@signal("frames_per_second")
def frames_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.floor(F.col("us") / 1000000 / 3600).alias("period"), (F.col("event_id") % 1000).cast("int").alias("frame_num"))
    return vdif.frames_per_second(rows, ("period",))


@signal("frame_runs")
def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 86400).alias("nr"))
    return vdif.runs(rows, "nr", ("user_id",)).select("user_id", F.col("first").alias("first_nr"), F.col("last").alias("last_nr"), "n")


@signal("union_streams")
def union_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.lit("o").alias("src"), F.col("o_totalprice").alias("x")).unionByName(table(spark, sf_dir, "events").select(F.lit("v").alias("src"), F.col("value").alias("x")))
    return rows.groupBy("src").agg(F.count("*").alias("n"), rounded(F.sum("x"), 2).alias("total"))


@signal("header_listing_limit")
def header_listing_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vdif.listing(named_fields(header_fields(spark, sf_dir)), ("id",), skip=10, limit=25)


@signal("result_listing")
def result_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.listed(events(spark, sf_dir).select("ch", "st", "event_id"), "ch", "p")


@signal("bulk_quantity_blocks")
def bulk_quantity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 4096).alias("acc"), F.col("l_linenumber").cast("int").alias("channel"))
    return rows.agg(F.count("*").alias("n"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total"))


@signal("stream_tumbling_vis")
def stream_tumbling_vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each station in windows of a day, by the streaming facade run to the end of the table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))")
    rows = stream.select(instant.alias("ts"), (F.col("user_id") % 4).cast("int").alias("st"), "value")
    return tumbling_power(rows).select(F.floor((F.unix_micros("start") - F.lit(1704067200000000)) / 86400e6).cast("long").alias("block"), "st", "n", (F.round("power", 2) + 0.0).alias("power"))


STREAM_SQL = {
    "stream_tumbling_vis": "SELECT CAST(floor(t / 86400) AS BIGINT) block, st, CAST(count(*) AS BIGINT) n, round(sum(value * value), 2) + 0.0 power FROM {V} v GROUP BY floor(t / 86400), st",
    "delay_asof": "SELECT event_id, CAST(least(8, floor(t / 259200)) AS BIGINT) section FROM {V} v",
}
ORACLE_SQL = {name: duckdb_sql(text) for name, text in (SQL | STREAM_SQL).items()}
