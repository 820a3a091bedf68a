"""Sums by pair: independent of the size of a run, of other streams' gaps and of how pairs are dealt."""

import numpy as np
import pytest

from fringeline.operators import fx
from fringeline.operators.correlate import accumulated, normalised

from .test_correlation import FS, SPF, scan, visibilities

KEYS = ("acc", "sp0", "sp1", "k")


def values(vis):
    return {tuple(r[c] for c in KEYS): (r.n_windows, r.re, r.im) for r in vis.collect()}


def alike(a, b):
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(np.array(a[k][1:], float), np.array(b[k][1:], float), atol=1e-9, equal_nan=True) for k in a)


@pytest.mark.parametrize("missing", [{(1, i) for i in range(60)}, {(1, i) for i in range(25, 200)} | {(0, 3)}, {(1, i) for i in range(0, 100, 3)}])
@pytest.mark.parametrize("late", [0, 5])
def test_runs_of_any_size_with_gaps(spark, tmp_path, missing, late):
    paths = scan(tmp_path, late, missing=missing)
    found = [values(visibilities(spark, paths, late / FS, windows_per_task=n)[1]) for n in (1, 7, 1024)]
    assert alike(found[0], found[1]) and alike(found[1], found[2])
    auto = max(n for (acc, a, b, _), (n, *_) in found[0].items() if acc == 0 and a == b == 0)
    both = max(n for (acc, a, b, _), (n, *_) in found[0].items() if acc == 0 and a != b)
    assert both < auto  # the pair has fewer windows than the whole stream


def test_frames_that_come_twice_count_once(spark, tmp_path):
    rows, vis = visibilities(spark, scan(tmp_path, 5), 5 / FS)
    again = rows.union(rows.where("station = 1"))
    assert alike(values(vis), values(fx.correlate(again, fft_size=32, period=1.0)))
    tones = lambda r: {(x.acc, x.sp, x.k): (x.n_windows, x.re, x.im) for x in fx.calibration(r).collect()}
    some = rows.selectExpr(*[c if c != "f_pcal" else "100.0D f_pcal" for c in rows.columns])
    assert alike(tones(some), tones(some.union(some)))
    assert SPF


def windows(streams, many, lost):
    r = np.random.default_rng(4)
    return [(0, 0, s, w, r.normal(size=8).tolist()) for s in range(streams) for w in range(many) if not lost(s, w)]


SCHEMA = "acc int, channel int, sp int, w long, samples array<double>"


@pytest.mark.parametrize("block", [1, 10, 20, 256])
def test_blocks_of_windows_with_a_late_stream(spark, block):
    rows = windows(3, 40, lambda s, w: s == 2 and w < 15)
    acc = normalised(accumulated(spark.createDataFrame(rows, SCHEMA), block=block)).collect()
    n = {(r.sp0, r.sp1): r.n_windows for r in acc}
    assert n[0, 1] == 40 and n[0, 2] == n[2, 2] == 25
    f = {(s, w): np.fft.fft(x) for _, _, s, w, x in rows}
    for r in acc:
        both = [w for w in range(40) if (r.sp0, w) in f and (r.sp1, w) in f]
        a, b = np.array([f[r.sp0, w] for w in both]), np.array([f[r.sp1, w] for w in both])
        v = (a[:, r.k] * b[:, r.k].conj()).sum() / np.sqrt((np.abs(a) ** 2).sum() * (np.abs(b) ** 2).sum())
        assert abs(v - complex(r.re, r.im)) < 1e-12


def test_pairs_without_a_common_window(spark):
    rows = windows(2, 10, lambda s, w: (w < 5) == (s == 0))
    acc = accumulated(spark.createDataFrame(rows, SCHEMA))
    assert {(r.sp0, r.sp1) for r in acc.collect()} == {(0, 0), (1, 1)}


@pytest.mark.parametrize("per_task", [2, 5, 16, 64])
def test_triangle(spark, per_task):
    rows = windows(21, 6, lambda s, w: s == 4 and w == 3 or s == 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert alike(values(accumulated(df)), values(accumulated(df, count=21, streams_per_task=per_task)))


def test_triangle_of_chunks(spark, tmp_path):
    paths = scan(tmp_path, 5, missing={(1, 9)})
    whole, parts = (values(visibilities(spark, paths, 5 / FS, **o)[1]) for o in ({}, {"streams": 4, "streams_per_task": 2}))
    assert alike(whole, parts)


def test_a_task_holds_two_groups_at_most(spark):
    from pyspark.sql import functions as F

    from fringeline.operators.correlate import dealt_in_triangle, groups_of

    width, groups = groups_of(64, 16)
    rows = dealt_in_triangle(spark.range(64).withColumnRenamed("id", "sp"), F.col("sp"), width, groups)
    tasks = rows.groupBy("low", "high").agg(F.count("*").alias("n")).collect()
    assert (width, groups) == (8, 8) and len(tasks) == 36 and max(t.n for t in tasks) <= 16
    assert rows.groupBy("sp").count().where("count <> 8").count() == 0


def drifting(spark, size, rate):
    """One block of two stations in chunks of so many samples; the second one's delay drifts."""
    r = np.random.default_rng(5)
    n, fs = 6400, 640.0
    rows = []
    for st in range(2):
        q = r.integers(0, 256, n).astype(np.uint8)
        for i in range(0, n, size):
            part = q[i : i + size]
            rows.append((0, 0, 0, st, 0, i, len(part), 0, 8, False, fs, 100.0, "U", 0, 0.0, 0.0, rate * st, 0.0, 0.0, bytearray(part.tobytes())))
    from fringeline.operators.align import CHUNKS

    return spark.createDataFrame(rows, CHUNKS)


@pytest.mark.parametrize("rate", [0.004, -0.004])
def test_slips_by_sample_for_chunks_of_any_size(spark, rate):
    run = lambda size, w: values(fx.correlate(drifting(spark, size, rate), fft_size=32, period=10.0, windows_per_task=w, by_sample=True))
    first = run(6400, 1024)
    assert first and alike(first, run(64, 1024)) and alike(first, run(77, 3)) and alike(first, run(1000, 10))
    by_window = values(fx.correlate(drifting(spark, 6400, rate), fft_size=32, period=10.0))
    assert not alike(first, by_window)


def test_moved_samples_are_those_of_dropping_and_inserting():
    """Slips one by one, as they come, give the same stream."""
    from fringeline.operators import kernels

    fs, n = 100.0, 1000
    for coeffs in (np.array([0.001, 0.005, 0.0]), np.array([0.0, -0.007, 0.0002])):
        x = np.arange(1.0, n + 1)
        at, keep = kernels.moved(coeffs, fs, int(np.floor(coeffs[0] * fs + 0.5)), 0, n)
        out, whole = [], int(np.floor(coeffs[0] * fs + 0.5))
        for m in range(n):
            now = int(np.floor(kernels.delay(coeffs, np.array(m / fs)) * fs + 0.5))
            out += [] if now > whole else [0.0] * (whole - now) + [x[m]]
            whole = now
        placed = np.zeros(at[keep].max() + 1)
        placed[at[keep]] = x[keep]
        assert placed.tolist() == out


def heads(spark, rows):
    """Chunks (stream, first sample, samples) of one block of two-polarisation stations."""
    from fringeline.operators.align import CHUNKS

    r = np.random.default_rng(6)
    return spark.createDataFrame([(0, 0, 0, sp // 2, sp % 2, first, n, 0, 8, False, 640.0, 100.0, "U", 0, 0.0, 0.0, 0.0, 0.0, 0.0, bytearray(r.integers(0, 256, n).astype(np.uint8).tobytes())) for sp, first, n in rows], CHUNKS)


def test_sessions_end_where_a_stream_comes_again(spark):
    df = heads(spark, [(0, 0, 64), (1, 0, 64), (0, 64, 64), (0, 128, 64), (1, 128, 64), (1, 192, 64), (1, 192, 64)])
    got = [(r.pol, r.first_sample, r.session, r.streams) for r in fx.sessions(df).orderBy("first_sample", "session", "pol").collect()]
    assert got == [(0, 0, 1, 2), (1, 0, 1, 2), (0, 64, 2, 1), (0, 128, 3, 2), (1, 128, 3, 2), (1, 192, 4, 1), (1, 192, 5, 1)]


def test_compacted_streams_align_by_rank(spark):
    """What is left after dismissal is correlated like streams without gaps."""
    rows = [(sp, 64 * i, 64) for sp in range(2) for i in range(20) if (sp, i) not in {(0, 3), (1, 7), (1, 8)}]
    df = heads(spark, rows + [(0, 0, 64)])
    kept, now = [], {}
    for sp, first, _ in sorted(rows, key=lambda r: (r[1], r[0])):  # one session after another
        if sp in now:
            kept += list(now.items()) if len(now) == 2 else []
            now = {}
        now[sp] = first
    kept += list(now.items()) if len(now) == 2 else []
    places = {(r.pol, r.first_sample): r.place for r in fx.places(heads(spark, rows), 2).collect()}
    want = {(sp, f): 64 * i for sp in range(2) for i, f in enumerate(sorted(f for s, f in kept if s == sp))}
    assert places == want and len(want) == 36
    whole = fx.compacted(heads(spark, rows), 2)
    assert [r.first_sample for r in whole.where("pol = 0").orderBy("first_sample").collect()] == [64 * i for i in range(18)]
    again = fx.compacted(df, 2)
    assert again.select("pol", "first_sample").distinct().count() == whole.count()
    vis = fx.correlate(whole, fft_size=32, period=10.0)
    assert {r.n_windows for r in vis.collect()} == {18}
    assert fx.compacted(df, 3).count() == 0
