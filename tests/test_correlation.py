import os

import numpy as np
import pytest

from fringeline.operators import align, delays, fx, post
from fringeline.operators.correlate import accumulated, normalised
from fringeline.sources import results, vdif

FS, SPF, N = 6400.0, 64, 32
POLYS = "block int, source_id int, station int, rel double, d0 double, d1 double, d2 double"
MEDIA = "station int, idx int, channel int, pol int, freq_hz double, sideband string, f_pcal double"


def scan(tmp_path, whole_delay=0, missing=(), period=1.0):
    """Frames of two stations that see the same noise; the second one later by whole samples."""
    r = np.random.default_rng(2)
    total = int(FS * 2)
    signal = r.normal(size=total + 200)
    level = lambda x: np.digitize(x, [-1, 0, 1]).astype(np.uint32)
    paths = []
    for st, late in ((0, 0), (1, whole_delay)):
        x = level(signal[100 - late : 100 - late + total])
        path = f"{tmp_path}/s{st}.vdif"
        with open(path, "wb") as f:
            for i in range(total // SPF):
                if (st, i) not in missing:
                    f.write(vdif.frame(x[i * SPF : (i + 1) * SPF], bits=2, seconds=i * SPF // int(FS), frame_num=i % (int(FS) // SPF), station_code=st, epoch=30))
        paths.append(path)
    return paths


def visibilities(spark, paths, rel, **options):
    frames = vdif.with_time(vdif.read_frames(spark, paths), FS).selectExpr("*", "station_code station", f"CAST({FS} AS DOUBLE) fs")
    polys = spark.createDataFrame([(b, 0, s, rel * s, rel * s, 0.0, 0.0) for b in range(2) for s in range(2)], POLYS)
    good = align.aligned(frames, polys, start=0.0, period=1.0, blocks=2)
    media = spark.createDataFrame([(s, 0, 0, 0, 0.0, "U", 0.0) for s in range(2)], MEDIA)
    rows = align.chunks(good, media)
    return rows, fx.correlate(rows, fft_size=N, period=1.0, **options)


def cross(vis):
    return np.array([complex(r.re, r.im) for r in vis.where("sp0 = 0 AND sp1 = 2 AND acc = 0").orderBy("k").collect()])


@pytest.mark.parametrize("late", [0, 5, 70])
def test_delays_are_taken_out(spark, tmp_path, late):
    _, vis = visibilities(spark, scan(tmp_path, late), late / FS)
    c = cross(vis)
    assert len(c) == N and np.abs(c.sum()) > 0.95 and np.abs(np.angle(c)).max() < 0.2


def test_wrong_delay_shows_a_slope(spark, tmp_path):
    _, vis = visibilities(spark, scan(tmp_path, 2), 0.0)
    k = np.arange(N) / (2 * N)
    assert np.abs((cross(vis) * np.exp(-2j * np.pi * 2 * k)).sum()) > 0.9


def test_runs_of_windows_do_not_change_the_sums(spark, tmp_path):
    paths = scan(tmp_path, 5)
    _, a = visibilities(spark, paths, 5 / FS, normalise=False)
    _, b = visibilities(spark, paths, 5 / FS, normalise=False, windows_per_task=7)
    d = post.difference(a, b).first()
    assert d.unmatched == 0 and d.difference < 1e-12


def test_missing_frames_stay_aligned(spark, tmp_path):
    rows, vis = visibilities(spark, scan(tmp_path, 0, missing={(1, 7), (1, 8), (0, 30)}), 0.0)
    assert np.abs(cross(vis).sum()) > 0.9
    stats = {(r.station, r.acc_block): r.n_missing for r in fx.stream_statistics(rows).collect()}
    assert stats[1, 0] == 2 * SPF and stats[0, 0] == SPF


def test_straddling_frames_lose_their_head(spark, tmp_path):
    rows, _ = visibilities(spark, scan(tmp_path, 5), 5 / FS)
    late = rows.where("station = 1 AND acc_block = 1").orderBy("first_sample").first()
    assert late.first_sample == 0 and late.shift == 5 and late.skip + late.n_samples == SPF


def test_calibration_tones(spark, monkeypatch):
    n, bins = 6400, 64
    x = np.cos(2 * np.pi * 8 * np.arange(n) / bins)
    q = np.round((x + 1) / 2 * 255).astype(np.uint8)
    cols = "acc_block int, source_id int, channel int, station int, pol int, first_sample long, n_samples int, skip int, bits int, is_complex boolean, fs double, freq_hz double, sideband string, shift long, f_pcal double, samples binary"
    row = lambda first, count, raw, skip=0: (0, 0, 0, 0, 0, first, count, skip, 8, False, FS, 3200.0, "U", 0, 100.0, bytearray(raw))
    whole = fx.calibration(spark.createDataFrame([row(0, n, q.tobytes())], cols), per_bin=True).orderBy("k").collect()
    size = np.abs([complex(t.re, t.im) for t in whole])
    assert len(size) == 64 and size.argsort()[-2:].tolist() in ([8, 56], [56, 8])
    monkeypatch.setattr(fx, "SPAN", 1000)  # folded in runs
    parts = [row(i + (7 if i else 0), 100 - (7 if i else 0), q[i : i + 100].tobytes(), 7 if i else 0) for i in range(0, n, 100)]
    again = fx.calibration(spark.createDataFrame([r for r in parts if r[6] == 100] + [row(i, 7, q[i : i + 7].tobytes()) for i in range(100, n, 100)] + [r for r in parts if r[6] == 93], cols), per_bin=True).orderBy("k").collect()
    assert np.allclose([(t.re, t.im) for t in again], [(t.re, t.im) for t in whole])


def test_accumulation_blocks_agree(spark):
    r = np.random.default_rng(0)
    rows = [(0, 0, s, w, r.normal(size=16).tolist()) for s in range(3) for w in range(20)]
    df = spark.createDataFrame(rows, "acc int, channel int, sp int, w long, samples array<double>")
    a, b = accumulated(df, block=256), accumulated(df, block=3)
    assert post.difference(a, b).first().difference < 1e-18
    total = normalised(a).where("sp0 = sp1").groupBy("sp0").sum("re").collect()
    assert all(abs(t[1] - 1) < 1e-9 for t in total)


def test_zoom_and_average(spark):
    vis = spark.createDataFrame([(0, 0, 0, 1, k, float(k), -float(k)) for k in range(32)], "acc int, channel int, sp0 int, sp1 int, k int, re double, im double")
    channels = spark.createDataFrame([(0, 100.0, 32.0)], "channel int, f double, bw double")
    zooms = spark.createDataFrame([(9, 104.0, 8.0), (8, 130.0, 8.0)], "zoom int, f double, bw double")
    z = post.zoom(vis, channels, zooms, 32).orderBy("k").collect()
    assert [(r.zoom, r.band, r.k, r.re) for r in z] == [(9, 1, i, 4.0 + i) for i in range(8)]
    assert post.zoom(vis.where("k < 31"), channels, zooms, 32).count() == 0  # too short
    assert post.zoom(vis, channels, zooms, 32, periods=[1]).count() == 0
    lower = spark.createDataFrame([(0, 132.0, 32.0, "L")], "channel int, f double, bw double, sideband string")  # named by its upper edge
    assert post.zoom(vis, lower, zooms, 32).orderBy("k").collect() == z
    assert [r.re for r in post.averaged(vis, 16).orderBy("k").collect()] == [7.5, 23.5]


def test_delay_polynomials_of_the_example(spark):
    blocks = spark.createDataFrame([(j, 57350, 95.0 + 68160 + j) for j in range(3)], "block int, mjd int, sec double")
    sections = spark.createDataFrame([(57350, 68160.0, 68280.0, 0, s, [1e-2 - s * 1e-3, 1e-7 * s, 1e-12, 0.0, 0.0, 0.0]) for s in range(2)], "mjd int, start_s double, end_s double, source_id int, station int, coeffs array<double>")
    clocks = spark.createDataFrame([("A", 0, 57350.0, 1e-6, 0.0), ("B", 1, 57350.0, 2e-6, 1e-12)], "name string, station int, clock_ref double, c0 double, c1 double")
    rel = delays.relative(delays.block_polynomials(blocks, sections, clocks)).orderBy("block", "station").collect()
    assert len(rel) == 6 and all(r.ref == 0 for r in rel)
    for r in rel:
        t = 95 + r.block
        q = [1e-2 - s * 1e-3 + 1e-7 * s * t + 1e-12 * t * t + (1e-6, 2e-6 + 1e-12 * (68255 + r.block))[s] for s in range(2)]
        assert abs(r.d0 - (q[0] - q[r.station])) < 1e-15 and r.d0 >= 0
        assert abs(r.q0 + r.k0 - q[r.station]) < 1e-15


def test_whole_and_fractional_samples(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(37419.3205516, False), (37422.5204922, False), (37422.5204922, True)], "x double, c boolean")
    shift, frac = delays.shift_and_fraction(F.col("x"), F.lit(1.0), F.col("c"))
    old, _ = delays.shift_and_fraction(F.col("x"), F.lit(1.0), F.col("c"), compat=True)
    got = [tuple(r) for r in df.select(shift, F.round(frac, 7), old).collect()]
    assert got == [(37419, 0.3205516, 37419), (37423, -0.4795078, 37423), (74846, -0.4795078, 74845)]


def test_experiment_from_files_to_results(spark, tmp_path):
    from fringeline import cli

    from .test_sources import INI

    paths = scan(tmp_path, 0)
    text = dict(INI)
    text["correlation"] = text["correlation"].replace("seconds_start = 100", "seconds_start = 0").replace("accumulation = 1/4", "accumulation = 1").replace("seconds_duration = 0.5", "seconds_duration = 2").replace("FFT = 16", f"FFT = {N}")
    text["media"] = text["media"].replace("a.vdif", paths[0].split("/")[-1]).replace("b.vdif", paths[1].split("/")[-1]).replace("1280", str(int(FS)))
    text["stations"] = text["stations"].replace("= 1:0", "= 0:0")
    text["delay_model"] = text["delay_model"].replace("= 7,", "= 5,").replace("57350", "57023")
    text["correlation"] = text["correlation"].replace("57350", "57023")  # the day of the frames
    for name, t in text.items():
        (tmp_path / f"{name}.ini").write_text(t)
    cli.main(["correlate", "--experiment", str(tmp_path), "--media", str(tmp_path), "--output", f"{tmp_path}/out"])
    vis = spark.read.parquet(f"{tmp_path}/out/visibilities")
    assert np.abs(cross(vis).sum()) > 0.95
    assert spark.read.parquet(f"{tmp_path}/out/statistics").count() == 4
    assert spark.read.parquet(f"{tmp_path}/out/dismissed").count() == 0
    assert post.difference(vis, vis).first().difference == 0
    args = ["--experiment", str(tmp_path)]
    cli.main(["export", f"{tmp_path}/out", *args, "--output", f"{tmp_path}/files"])
    got = results.read_swin(spark, f"{tmp_path}/files/DIFX_57023_0.s0000.b0000", N).orderBy("seconds", "st0", "st1").collect()
    assert [(r.seconds, r.st0, r.st1) for r in got] == [(t, a, b) for t in (0.5, 1.5) for a, b in ((0, 0), (0, 1), (1, 1))]
    cli.main(["text", f"{tmp_path}/out", *args, "--output", f"{tmp_path}/text"])
    lines = spark.read.text(f"{tmp_path}/text")
    assert lines.count() == 6 and all(len(r.value.split("\t")[1].split(" ")) == 28 + N for r in lines.collect())
    assert results.read_text_lines(lines).count() == 6
    counts = spark.read.parquet(f"{tmp_path}/out/counts").first()
    assert (counts.frames, counts.truncated, counts.invalid) == (2 * 2 * int(FS) // SPF, 0, 0) and counts.bytes == sum(os.path.getsize(p) for p in paths)
    cli.main(["correlate", *args, "--media", str(tmp_path), "--output", f"{tmp_path}/out3", "--ordered"])
    assert post.difference(vis, spark.read.parquet(f"{tmp_path}/out3/visibilities")).first().difference == 0
    cli.main(["correlate", *args, "--media", str(tmp_path), "--output", f"{tmp_path}/out2", "--set", "correlation.elements.autocorr_station=no", "--set", "correlation.computation.phase_calibration=no"])
    assert {(r.sp0, r.sp1) for r in spark.read.parquet(f"{tmp_path}/out2/visibilities").select("sp0", "sp1").distinct().collect()} == {(0, 2)}
    assert not (tmp_path / "out2" / "calibration").exists()
    with pytest.raises(SystemExit):
        cli.main(["compare", f"{tmp_path}/out/visibilities", f"{tmp_path}/out2/visibilities", "--most", "0"])


def frames_of(spark, rows):
    """Frames (station, t, samples) of two bits."""
    made = [(s, 0, t, FS, 2, False, 0, True, False, bytearray(vdif.pack(x, 2))) for s, t, x in rows]
    return spark.createDataFrame(made, "station int, thread_id int, t double, fs double, bits int, is_complex boolean, log2_channels int, complete boolean, invalid boolean, payload binary")


@pytest.mark.parametrize("runs", [64, 1024])
def test_delays_that_drift_are_followed(spark, runs):
    """A stream that is stretched against the other by 400 samples in a block of 32000."""
    r = np.random.default_rng(5)
    rate, n = 400 / 32000, 32000
    signal = np.digitize(r.normal(size=n + 600), [-1, 0, 1]).astype(np.uint32)
    late = signal[np.clip(np.round(np.arange(-1, n + 600) / (1 + rate)), 0, None).astype(int)]  # seen at t is what the other saw at t / (1 + rate)
    x = [(0, i / 100, signal[i * 64 : i * 64 + 64]) for i in range(500)] + [(1, i / 100, late[i * 64 + 1 : i * 64 + 65]) for i in range(500)]
    polys = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.0, 0.0), (0, 0, 1, 0.0, 0.0, rate, 0.0)], POLYS)
    media = spark.createDataFrame([(s, 0, 0, 0, 0.0, "U", 0.0) for s in range(2)], MEDIA)
    rows = align.chunks(align.aligned(frames_of(spark, x), polys, start=0.0, period=5.0, blocks=1), media)
    vis = fx.correlate(rows, fft_size=16, period=5.0, windows_per_task=runs)
    got = vis.where("sp0 = 0 AND sp1 = 2").collect()
    assert abs(sum(complex(v.re, v.im) for v in got)) > 0.7
    assert got[0].n_windows == sum(w * 32 + round(w * 32 * rate) < n for w in range(1000))  # the windows past the block's end have no samples


def test_margins_are_the_polynomials_own():
    from fringeline.operators import kernels

    assert kernels.drift(np.array([0.0, 400 / 6400, 0.0]), 6400.0, 1.0, 0) == 402
    assert kernels.drift(np.array([0.0, 1.0, -1.0]), 100.0, 1.0, 0) == 27  # at the turn


def test_sources_stay_apart(spark):
    r = np.random.default_rng(3)
    x = [(s, i / 100, r.integers(0, 4, 64)) for s in range(2) for i in range(100)]
    rows = [(0, src, s, s * src / FS, s * src / FS, 0.0, 0.0) for src in range(2) for s in range(2)]
    media = spark.createDataFrame([(s, 0, 0, 0, 0.0, "U", 0.0) for s in range(2)], MEDIA)
    run = lambda some: align.chunks(align.aligned(frames_of(spark, x), spark.createDataFrame(some, POLYS), start=0.0, period=1.0, blocks=1), media)
    both = run(rows)
    assert both.count() == 2 * 2 * 100
    alone = fx.correlate(run([p for p in rows if p[1] == 1]), fft_size=16, period=1.0)
    assert post.difference(fx.correlate(both, fft_size=16, period=1.0).where("source_id = 1"), alone).first().difference < 1e-18


def test_scans_over_midnight(spark):
    from fringeline.sources import experiment as ex

    e = ex.Experiment(16, 1.0, 57350, 86398.0, 4.0)
    blocks = ex.block_table(spark, e)
    assert [(r.mjd, r.sec) for r in blocks.orderBy("block").collect()] == [(57350, 86398.0), (57350, 86399.0), (57351, 0.0), (57351, 1.0)]
    sections = spark.createDataFrame([(57350, 86000.0, 86500.0, 0, 0, [1e-3, 1e-6])], "mjd int, start_s double, end_s double, source_id int, station int, coeffs array<double>")
    clocks = spark.createDataFrame([(0, 57350.0, 0.0, 0.0)], "station int, clock_ref double, c0 double, c1 double")
    q = [r.q0 for r in delays.block_polynomials(blocks, sections, clocks).orderBy("block").collect()]
    assert np.allclose(q, 1e-3 + 1e-6 * np.arange(398, 402))
    heads = spark.createDataFrame([(31, 146 * 86400 + 86399, 0), (31, 147 * 86400, 1)], "epoch int, seconds long, frame_num int").selectExpr("*", "1632L frame_bytes", "2 bits", "false is_complex", "0 log2_channels")
    assert [(r.mjd, r.t) for r in vdif.with_time(heads, 6400.0, mjd_start=57350).orderBy("seconds").collect()] == [(57350, 86399.0), (57351, 86401.0)]


def test_layouts_are_unpacked_together(spark):
    """Frames of several channels, complex ones and other bits in one batch."""
    r = np.random.default_rng(4)
    kinds = [(2, 2, False), (1, 0, False), (4, 1, True), (8, 0, True), (16, 1, False)]
    made, want = [], {}
    for st, (bits, log2, is_complex) in enumerate(kinds):
        for i in range(3):
            x = r.integers(0, 1 << bits, 64)
            per = 64 // (1 << log2) // (2 if is_complex else 1)
            made.append((st, 0, i * per / FS, FS, bits, is_complex, log2, True, False, bytearray(vdif.pack(x, bits))))
            for c, part in enumerate(vdif.corner_turn(x, 1 << log2, is_complex)):
                want[st, c, i * per] = part
    frames = spark.createDataFrame(made, "station int, thread_id int, t double, fs double, bits int, is_complex boolean, log2_channels int, complete boolean, invalid boolean, payload binary").coalesce(1)
    polys = spark.createDataFrame([(0, 0, s, 0.0, 0.0, 0.0, 0.0) for s in range(5)], POLYS)
    media = spark.createDataFrame([(s, i, i, 0, 0.0, "U", 0.0) for s in range(5) for i in range(4)], MEDIA)
    from fringeline.operators import kernels

    got = align.chunks(align.aligned(frames, polys, start=0.0, period=1.0, blocks=1), media).collect()
    assert len(got) == len(want)
    for c in got:
        per = 2 if c.is_complex else 1
        assert kernels.components(bytes(c.samples), c.bits)[: c.n_samples * per].tolist() == want[c.station, c.channel, c.first_sample].tolist()


def test_zoom_and_file_listings_on_the_command_line(spark, tmp_path, capfd):
    from fringeline import cli

    vis = spark.createDataFrame([(a, 0, 0, 1, k, float(k), -float(k)) for a in range(2) for k in range(32)], "acc int, channel int, sp0 int, sp1 int, k int, re double, im double")
    vis.write.parquet(f"{tmp_path}/vis")
    cli.main(["zoom", f"{tmp_path}/vis", "--channels", "100:32", "--zooms", "104:8", "--fft", "32", "--average", "4", "--periods", "1", "--output", f"{tmp_path}/zoom"])
    got = spark.read.parquet(f"{tmp_path}/zoom").orderBy("k").collect()
    assert [(r.acc, r.band, r.k, r.re) for r in got] == [(1, 1, 0, 5.5), (1, 1, 1, 9.5)]
    paths = scan(tmp_path)
    cli.main(["vdif-info", paths[0], "--skip", "2", "--limit", "3"])
    cli.main(["vdif-info", *paths, "--summary"])
    out = capfd.readouterr().out
    assert "frames_per_second" in out and out.count("s0.vdif") == 4
