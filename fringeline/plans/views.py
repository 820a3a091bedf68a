"""The driver's tables as signals, times, frames and dimensions of an experiment, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sampling of the streams made of vectors, and samples of a window.
FS = 64.0
N = 64
#: First day of the events, as a Modified Julian day; delay sections last three days.
MJD = 60310
SECTION = 259200.0
STATIONS = ((0, "AA", 0.10, 0.001), (1, "BB", 0.25, -0.002), (2, "CC", 0.05, 0.0005), (3, "DD", 0.40, 0.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as windows: stream vec_id mod 4, window vec_id div 4, accumulation of 25 windows."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 100).cast("int").alias("acc"), F.lit(0).alias("channel"), (v % 4).cast("int").alias("sp"), F.floor(v / 4).alias("w"), F.col("embedding").cast("array<double>").alias("samples"))


def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows with their streams' sampling, frequency and quadratic delay; odd streams are of the lower sideband."""
    sp = F.col("sp")
    return streams(spark, sf_dir).select("acc", "channel", "sp", "w", "samples", F.lit(FS).alias("fs"), (F.lit(1000.25) + 10.5 * sp).alias("freq"), (sp % 2 == 1).alias("lower_complex"), (0.001 * (sp + 1)).alias("d0"), F.lit(0.0007).alias("d1"), F.lit(0.00001).alias("d2"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", (us / 1e6).alias("t"), us.alias("us"), (F.col("user_id") % 4).cast("int").alias("st"), "user_id", F.col("event_type").alias("ch"), "value")


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns that the delay lookups use."""
    return events(spark, sf_dir).select("event_id", "ch", "t", F.col("st").alias("station"), F.lit(MJD).alias("mjd"), F.col("t").alias("sec"))


def sections(spark: SparkSession) -> DataFrame:
    """Delay polynomials of degree five, by section and station, in seconds."""
    rows = []
    for k in range(9):
        for st, *_ in STATIONS:
            p = (1000.0 + 37.0 * st - 3.0 * k, 0.01 * (st + 1), -0.0001 * (k + 1), 0.000001 * st, 0.00000001, -0.0000000001)  # microseconds and days
            rows.append((k, MJD, k * SECTION, (k + 1) * SECTION, 0, st, [x / 1e6 / 86400.0**n for n, x in enumerate(p)]))
    return spark.createDataFrame(rows, "section long, mjd int, start_s double, end_s double, source_id int, station int, coeffs array<double>")


def clocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(st, name, float(MJD), c0 / 1e6, c1 / 1e6 / 86400) for st, name, c0, c1 in STATIONS], "station int, name string, clock_ref double, c0 double, c1 double")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each customer, at times all over the days that the sections cover."""
    t = F.col("c_custkey") * 97777 % 2332800
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("block"), (F.lit(MJD) + F.floor(t / 86400)).cast("int").alias("mjd"), (t % 86400).cast("double").alias("sec"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of a nation as the stations of a band, numbered from 0."""
    nr = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("band"), nr.alias("sp"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header words made from keys; each fits 32 bits."""
    k = F.col("o_orderkey").cast("long")
    made = [(k * a + b).bitwiseAND(4294967295).alias(f"w{i}") for i, (a, b) in enumerate(((2654435761, 0), (40503, 12345), (2246822519, 7), (3266489917, 99)))]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *made)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors quantised to two bits as frames of 64 samples, one a second: stations 0 and 1, of two polarisations each."""
    from fringeline.operators import samples

    v = F.col("vec_id")
    q = F.transform("embedding", lambda x: F.least(F.lit(3), F.greatest(F.lit(0), F.floor(x.cast("double") * 4 + 2))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(
        (v % 2).cast("int").alias("station"), (F.floor(v / 2) % 2).cast("int").alias("thread_id"), F.floor(v / 4).cast("double").alias("t"), F.lit(FS).alias("fs"), F.lit(2).alias("bits"),
        F.lit(False).alias("is_complex"), F.lit(0).alias("log2_channels"), F.lit(True).alias("complete"), F.lit(False).alias("invalid"), q.alias("q"),
    )
    return samples.packed(rows, 2, out="payload").drop("q")


#: Blocks of 25 seconds of those frames, as many as the largest table has; the second station sees all 3.2 samples later, and a little more each second.
PERIOD = 25.0
BLOCKS = 1 << 14
LATE = 0.05
RATE = 0.05
FREQ = 1000.25


def frame_model(spark: SparkSession) -> DataFrame:
    rows = spark.range(2 * BLOCKS).select(F.floor(F.col("id") / 2).cast("int").alias("block"), F.lit(0).alias("source_id"), (F.col("id") % 2).cast("int").alias("station"))
    late = LATE * F.col("station")
    return rows.select("block", "source_id", "station", late.alias("rel"), late.alias("d0"), (RATE * F.col("station")).alias("d1"), F.lit(0.0).alias("d2"))


def frame_media(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, p, 0, p, FREQ, "U", 16.0) for s in range(2) for p in range(2)], "station int, idx int, channel int, pol int, freq_hz double, sideband string, f_pcal double")
