"""Queries written in SQL over the library's table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringeline.functions import tables
from fringeline.plans import views
from fringeline.plans.correlation import ORACLE_SQL as CORRELATION
from fringeline.plans.signals import ORACLE_SQL as SIGNALS

VISIBILITIES = """
WITH parts AS (SELECT * FROM correlate_windows(TABLE(SELECT acc, channel, sp, w, samples, w DIV 7 AS run FROM {streams}) PARTITION BY (acc, channel, run))),
pairs AS (SELECT acc, channel, sp0, sp1, n_windows, p0, p1, posexplode(arrays_zip(re, im)) AS (k, v) FROM parts),
sums AS (SELECT acc, sp0, sp1, k, sum(v.re) re, sum(v.im) im, sum(n_windows) n_windows, sum(p0) p0, sum(p1) p1 FROM pairs GROUP BY acc, channel, sp0, sp1, k)
SELECT acc, sp0, sp1, k, round(re / sqrt(nullif(p0 * p1, 0D)), 6) + 0.0D re, round(im / sqrt(nullif(p0 * p1, 0D)), 6) + 0.0D im, n_windows FROM sums"""
TONES = """
WITH folded AS (SELECT * FROM fold_period(TABLE(SELECT CAST(floor(o_orderkey / 1024) AS BIGINT) acc, o_orderkey DIV 256 AS run, o_orderkey n, o_totalprice x, 16 bins FROM {orders}) PARTITION BY (acc, run))),
bins AS (SELECT acc, bin, sum(s) s, sum(n) n FROM folded GROUP BY acc, bin)
SELECT acc, k, round(re, 4) + 0.0D re, round(im, 4) + 0.0D im FROM tones_of(TABLE(SELECT * FROM bins) PARTITION BY acc)"""
UNPACKED = "SELECT id, i, q FROM unpack_words(TABLE(SELECT id, w0 AS word, 2 AS bits FROM {words}))"


def sql_visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql(VISIBILITIES, streams=views.streams(spark, sf_dir))


def sql_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql(TONES, orders=views.table(spark, sf_dir, "orders"))


def sql_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql(UNPACKED, words=views.words(spark, sf_dir))


QUERIES = {f.__name__: f for f in (sql_visibilities, sql_tones, sql_unpacked)}
ORACLE_SQL = {"sql_visibilities": CORRELATION["fx_visibilities"], "sql_tones": SIGNALS["pcal_tones"], "sql_unpacked": SIGNALS["unpack_bits"]}
