"""Range joins and checked broadcasts against plain loops, on random rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fringeline.operators import delays, post
from fringeline.operators.joins import dimension, last_before


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dimension_is_broadcast_up_to_its_size(spark):
    assert "broadcast" in plan(spark.range(9).join(dimension(spark.range(5), 5), "id"))
    assert "broadcast" not in plan(spark.range(9).join(dimension(spark.range(6), 5), "id"))


def test_sections_by_hours(spark):
    r = random.Random(3)
    sections, rows = [], []
    for station in range(3):
        at = 0.0
        for n in range(12):
            end = at + r.choice([0.25, 1800.0, 3600.0, 7200.5, 90000.0])
            sections.append((60310, at, end, station, n))
            at = end + r.choice([0.0, 0.0, 60.0])
    sections.append((60310, 5.0, 5.0, 0, 99))  # an empty one
    edges = [x for s in sections for x in s[1:3]]
    for i in range(600):
        t = r.choice(edges) if i % 3 == 0 else r.uniform(-5000, 300000)
        day = int(t // 86400)
        rows.append((i, 60310 + day, t - day * 86400, r.randint(0, 3)))
    s = spark.createDataFrame(sections, "mjd int, start_s double, end_s double, station int, nr int")
    df = spark.createDataFrame(rows, "id int, mjd int, sec double, station int")
    want = {(i, nr) for i, mjd, sec, station in rows for m, a, b, st, nr in sections if st == station and a <= (mjd - m) * 86400 + sec < b}
    got = delays.in_sections(df, s)
    assert sorted((x.id, x.nr) for x in got.collect()) == sorted(want) and "CartesianProduct" not in plan(got)
    assert {x.id for x in delays.without_section(df, s).collect()} == {x[0] for x in rows} - {i for i, _ in want}
    free = delays.in_sections(df.drop("station"), s)
    assert sorted((x.id, x.station, x.nr) for x in free.collect()) == sorted((i, st, nr) for i, mjd, sec, _ in rows for m, a, b, st, nr in sections if a <= (mjd - m) * 86400 + sec < b)


def test_last_before_in_any_number_of_stretches(spark):
    r = random.Random(4)
    states = [(k, t, f"{k}-{t}") for k in "abc" for t in sorted(r.sample(range(0, 5000), 40))] + [("d", None, "x")]
    rows = [(i, r.choice("aaaabcde"), r.choice([float(r.randint(-50, 6000)), None]) if i % 10 == 0 else float(r.randint(-50, 6000))) for i in range(500)] + [(500, None, 7.0)]
    s, df = spark.createDataFrame([(k, None if t is None else float(t), w) for k, t, w in states], "k string, since double, what string"), spark.createDataFrame(rows, "id int, k string, t double")
    want = {}
    for i, k, t in rows:
        held = [(u, w) for q, u, w in states if q == k and u is not None and t is not None and u <= t]
        want[i] = max(held)[1] if held else None
    for n in (1, 7, 1024):
        got = last_before(df, s, ("k",), "t", "since", stretches=n).collect()
        assert len(got) == len(rows) and {x.id: x.what for x in got} == want
    assert [x.what for x in last_before(df.limit(3), s.where(F.lit(False)), ("k",), "t", "since").collect()] == [None] * 3


def test_zoom_bands_in_many_channels_of_the_same_edges(spark):
    """Pairs of one stretch are made by all tasks, not by the one that the stretch falls to; edges, sidebands and nulls as one by one."""
    channels = [(i, 32e6, 32e6, "L") for i in range(1500)] + [(i, 0.0, 32e6, "U") for i in range(1500, 3000)] + [(3000, 16e6, 32e6, "U"), (3001, None, 32e6, "U"), (3002, 16e6, None, "U")]
    zooms = [(i, i * 1e6, 1e6 * (i % 3)) for i in range(-2, 70)] + [(100, None, 1e6), (101, 1e6, None)]
    z = spark.createDataFrame(zooms, "zoom long, f double, bw double")
    c = spark.createDataFrame(channels, "channel long, f double, bw double, sideband string")
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as tables too large to broadcast are joined
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got = post.contained(z, c).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    low = lambda f, bw, side: f - bw if side == "L" else f
    want = [(i, z) for i, cf, cbw, side in channels for z, f, bw in zooms if None not in (cf, cbw, f, bw) and low(cf, cbw, side) <= f and f + bw <= low(cf, cbw, side) + cbw]
    assert sorted((r.channel, r.zoom) for r in got) == sorted(want)
    parts = Counter(r.part for r in got if 0 <= r.f < 32e6)
    assert len(parts) == 4 and max(parts.values()) < sum(parts.values()) / 2


def test_pairs_of_many_channels_take_little_of_a_file(spark, tmp_path):
    """Each list of channels meets all zoom bands of its task before the next, so a file holds the same few numbers again and again."""
    c = spark.range(40_000).select(F.col("id").alias("channel"), F.lit(0.0).alias("f"), F.lit(32e6).alias("bw"))
    z = spark.range(1500).select(F.col("id").alias("zoom"), (F.col("id") % 31 * 1e6).alias("f"), F.lit(1e6).alias("bw")).where(F.pmod(F.xxhash64("zoom"), F.lit(post.DEALT)) == 0)
    n = z.count()
    assert 10 < n < 40
    post.contained(z, c).select("zoom", "channel").write.parquet(out := str(tmp_path / "out"))
    got = spark.read.parquet(out)
    assert got.count() == 40_000 * n == got.distinct().count()
    own = got.where("zoom IS NOT NULL").groupBy("zoom").agg(F.count_distinct("channel").alias("n"))
    assert {r.n for r in own.collect()} == {40_000}
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1.5 * 40_000 * n


def test_zoom_bands_of_one_channel_are_held_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(post, "HELD", 10)
    z = spark.createDataFrame([(i, i * 1e5, 1e6) for i in range(200)], "zoom long, f double, bw double")
    c = spark.createDataFrame([(1, 0.0, 16e6), (2, 8e6, 8e6), (None, 8e6, 8e6)], "channel long, f double, bw double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = post.contained(z, c).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert Counter((r.channel, r.zoom) for r in got) == Counter([(1, i) for i in range(151)] + [(x, i) for x in (2, None) for i in range(80, 151)])
    assert len({r.part for r in got if r.channel == 1}) == 4
