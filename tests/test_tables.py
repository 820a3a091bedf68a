"""Table functions in SQL, and the tumbling stream's table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeline.functions import tables
from fringeline.operators.correlate import accumulated
from fringeline.streaming.tumbling import tumbling_power

from .test_gaps import SCHEMA, alike, values, windows


@pytest.mark.parametrize("run", [1, 4, 100])
def test_correlate_windows(spark, run):
    rows = spark.createDataFrame(windows(3, 12, lambda s, w: s == 2 and w < 5), SCHEMA)
    tables.register(spark)
    parts = spark.sql(f"SELECT * FROM correlate_windows(TABLE(SELECT acc, channel, sp, w, samples, w DIV {run} AS run FROM {{rows}}) PARTITION BY (acc, channel, run))", rows=rows)
    pairs = parts.select("acc", "sp0", "sp1", "n_windows", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    got = pairs.groupBy("acc", "sp0", "sp1", "k").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"), F.sum("n_windows").alias("n_windows"))
    assert alike(values(got), values(accumulated(rows)))


def test_fold_tones_and_words(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(a, i // 7, i, float(i % 8 == 3) + a, 8) for a in range(2) for i in range(40)], "acc long, run int, n long, x double, bins int")
    folded = spark.sql("SELECT acc, bin, sum(s) s, sum(n) n FROM fold_period(TABLE({rows}) PARTITION BY (acc, run)) GROUP BY acc, bin", rows=rows)
    assert {(r.acc, r.bin): (r.s, r.n) for r in folded.collect()} == {(a, b): (5.0 * (b == 3) + 5 * a, 5) for a in range(2) for b in range(8)}
    tones = spark.sql("SELECT * FROM tones_of(TABLE({folded}) PARTITION BY acc) WHERE acc = 0", folded=folded)
    got = {r.k: complex(r.re, r.im) for r in tones.collect()}
    assert np.allclose([got[k] for k in range(8)], np.exp(-2j * np.pi * 3 * np.arange(8) / 8) / 8)
    words = spark.createDataFrame([(1, 0b11100100), (2, 2**32 - 1)], "id long, word long")
    q = spark.sql("SELECT * FROM unpack_words(TABLE(SELECT *, 2 AS bits FROM {words}))", words=words).orderBy("id", "i").collect()
    assert [r.q for r in q] == [0, 1, 2, 3] + [0] * 12 + [3] * 16


def test_tumbling_table_over_micro_batches(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).cast("int").alias("st"), F.col("id").cast("double").alias("value"))
    folder = f"{tmp_path}/in"
    for part in (rows.where("id < 150"), rows.where("id >= 150"), rows.where("id < 3")):  # the last ones come late
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    got = {(r.start, r.st): (r.n, r.power) for r in tumbling_power(stream).collect()}
    all_ = rows.union(rows.where("id < 3"))
    want = all_.groupBy(F.window("ts", "1 day").start.alias("start"), "st").agg(F.count("*").alias("n"), F.sum(F.col("value") ** 2).alias("power")).collect()
    assert got == {(r.start, r.st): (r.n, r.power) for r in want}
