import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeline.sources import experiment as E
from fringeline.sources import results, vdif


@given(st.sampled_from([1, 2, 4, 8]), st.data())
@settings(deadline=None, max_examples=40)
def test_pack_and_unpack(bits, data):
    x = data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=200))
    assert vdif.unpack(vdif.pack(np.array(x, np.uint32), bits), bits)[: len(x)].tolist() == x


@given(st.fixed_dictionaries({name: st.integers(0, 2**n - 1) for name, (_, _, n) in vdif.FIELDS.items()}))
@settings(deadline=None)
def test_headers(fields):
    assert vdif.decode_header(vdif.encode_header(**fields)) == fields


def test_corner_turns():
    assert vdif.corner_turn(np.arange(12), 3, False).tolist() == [[0, 3, 6, 9], [1, 4, 7, 10], [2, 5, 8, 11]]
    assert vdif.corner_turn(np.arange(12), 3, True).tolist() == [[0, 1, 6, 7], [2, 3, 8, 9], [4, 5, 10, 11]]


def write(path, frames=25, truncated=True):
    r = np.random.default_rng(1)
    with open(path, "wb") as f:
        for i in range(frames):
            f.write(vdif.frame(r.integers(0, 4, 128), bits=2, seconds=100 + i // 10, frame_num=i % 10, epoch=31, station_code=7, thread_id=i % 2))
        if truncated:
            f.write(vdif.frame(r.integers(0, 4, 128), bits=2, seconds=105, frame_num=0, epoch=31, station_code=7)[:40])


def test_data_source_splits_and_filters(spark, tmp_path):
    write(tmp_path / "a.vdif")
    one = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"]).collect()
    many = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"], frames_per_partition="4").collect()
    assert sorted(one) == sorted(many) and len(one) == 26 and sum(not r.complete for r in one) == 1
    some = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"], t_start="101", t_end="102", payload="false").collect()
    assert len(some) == 10 and all(len(r.payload) == 0 for r in some)


def test_conditions_reach_the_headers(spark, tmp_path):
    write(tmp_path / "a.vdif")
    condition = "seconds >= 101 AND seconds <= 101 AND station_code IN (7, 8) AND frame_num > 3"
    want = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"]).where(condition).collect()
    spark.conf.set(vdif.PUSH, "true")
    try:
        frames = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"])
        got, plan = frames.where(condition).collect(), frames.where(condition)._jdf.queryExecution().executedPlan().toString()
        assert frames.where("station_code = 8").count() == 0 and frames.where("seconds > 101 AND seconds < 103").count() == 5
    finally:
        spark.conf.set(vdif.PUSH, "false")
    assert got == want and len(got) == 6
    left = plan[plan.index("Filter") : plan.index("BatchScan")]
    assert "> 3" in left and "101" not in left


def test_summary_and_time(spark, tmp_path):
    write(tmp_path / "a.vdif", truncated=False)
    frames = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"])
    (s,) = vdif.file_summary(frames).collect()
    assert (s.frames, s.stations, s.threads, s.seconds, s.frames_per_second) == (25, 1, 2, 3, 10)
    r = vdif.with_time(frames, 1280.0).orderBy("offset").collect()
    assert r[0].mjd == 51544 + 5479 + 181 and abs(r[3].t - (100 + 0.3)) < 1e-9  # 31 half-years: 2015-07-01


def test_swin_record_is_74_bytes_and_reads_back(spark, tmp_path):
    import struct

    assert struct.calcsize(results.SWIN) == 74
    rows = [(1, 0, 0, 0, 1, 1, 5, [1.0, 2.0], [0.5, -0.5]), (0, 3, 0, 1, 0, 0, 5, [3.0, 4.0], [0.0, 1.0])]
    vis = spark.createDataFrame(rows, "acc int, channel int, st0 int, pol0 int, st1 int, pol1 int, n_windows long, re array<double>, im array<double>")
    results.write_swin(vis, f"{tmp_path}/r", mjd=57350, start=10.0, period=2.0, parts=3)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").iterdir()))
    (tmp_path / "one").write_bytes(whole)
    assert [r.seconds for r in results.read_swin(spark, f"{tmp_path}/one", 2).collect()] == [11.0, 13.0]  # in order
    got = results.read_swin(spark, f"{tmp_path}/r", 2).orderBy("seconds").collect()
    assert [(g.seconds, g.st0, g.st1, g.pols, list(g.re)) for g in got] == [(11.0, 0, 0, "YX", [3.0, 4.0]), (13.0, 0, 1, "XY", [1.0, 2.0])]
    back = results.read_text_lines(results.text_lines(vis, 4)).orderBy("acc").collect()
    assert [(b.acc, b.channel, b.st0, b.pol0, b.st1, b.pol1, b.n_windows, b.re, b.im) for b in back] == sorted(rows)


def test_calibration_files(spark, tmp_path):
    """Bands of 20 MHz up to 120 and 140 MHz, tones every 10 MHz: 20 coefficients, places 20 (outside), 10 and 0."""
    tones = spark.createDataFrame([(acc, c, 2 * st, k, 1.0 + k, -2.0) for acc in range(2) for c in range(2) for st in range(2) for k in range(20)], "acc int, channel int, sp int, k int, re double, im double")
    bands = spark.createDataFrame([(0, 120e6, 20e6, 10e6, 20), (1, 140e6, 20e6, 10e6, 20)], "channel int, f double, bw double, f_pcal double, n int")
    stations = spark.createDataFrame([(0, "AA"), (1, "BB")], "station int, name string")
    lines = results.calibration_lines(results.tone_records(tones, bands), stations, mjd=57350, start=86399.0, period=2.0, n_bands=2, n_tones=2)
    results.write_calibration(lines, str(tmp_path), mjd=57350, start=86399.0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["PCAL_57350_086399_AA", "PCAL_57350_086399_BB"]
    got = (tmp_path / "PCAL_57350_086399_BB").read_text().splitlines()
    assert got[:5] == ["# Pulse cal data", "# File version = 1", "# Start MJD = 57350", "# Start seconds = 86399", "# Telescope name = BB"]
    band = lambda f: f"-1 0 0 0 {f - 10} X  1.10000e+01 -2.00000e+00 {f - 20} X  1.00000e+00 -2.00000e+00"
    assert got[5:] == [f"BB {day} 0.0000231 1 2 2 {band(120)} {band(140)}" for day in ("57351.0000000", "57351.0000231")]


def test_calibration_numbers_are_rounded_as_c_does(spark):
    """Ties of the shortest decimals, whose doubles are below or above them, and true ties, which go to even."""
    values = [9.765625e-4, 1.953125e-3, 0.1234565, -2.5, 0.0, 1e-120, float("inf")]
    tones = spark.createDataFrame([(acc, 0, 0, 0, v, -v) for acc, v in enumerate(values)] + [(acc, 0, 0, 0, 1.0, None if acc == 40 else 1.0) for acc in range(13, 100, 27)], "acc int, channel int, sp int, k int, re double, im double")
    bands = spark.createDataFrame([(0, 100e6, 10e6, 10e6, 10)], "channel int, f double, bw double, f_pcal double, n int")
    records = results.tone_records(tones, bands).where("nr = 1")
    text = {r.acc: r.text for r in records.collect()}
    number = lambda x: (" " if x > 0 else "") + "%.5e" % x
    assert [text[i] for i in range(len(values))] == [f"90 X {number(v)} {number(-v)}" for v in values]
    assert text[0] == "90 X  9.76562e-04 -9.76562e-04" and text[40] == results.INVALID_TONE
    lines = results.calibration_lines(records, spark.createDataFrame([(0, "AA")], "station int, name string"), mjd=60310, start=0.0, period=1.0, n_bands=1, n_tones=1)
    days = {r.acc: r.value.split()[1] for r in lines.collect()}
    assert days == {acc: "%.7f" % (60310 + (acc + 0.5) / 86400) for acc in text} and days[13] == "60310.0001562"


def test_text_lines_of_tones(spark):
    tones = spark.createDataFrame([(1, 2, 3, k, float(k), -0.5, 7) for k in range(3)], "acc int, channel int, sp int, k int, re double, im double, n_windows long")
    lines = results.tone_lines(tones, 4)
    (r,) = lines.collect()
    assert r.value.startswith("pcal-1.1-1.1-a.6.1.2-sxa7\t0 0 ") and r.value.endswith(" 0.2 (0.0-0.5j) (1.0-0.5j) (2.0-0.5j)")
    (b,) = results.read_text_lines(lines, "pcal").collect()
    assert (b.st0, b.pol0, b.re) == (1, 1, [0.0, 1.0, 2.0]) and results.read_text_lines(lines).count() == 0


def test_damaged_files(spark, tmp_path):
    """A frame of zeros in the middle, and a tail of zeros, are rows that are not complete; the rest is read."""
    write(tmp_path / "a.vdif", truncated=False)
    raw = bytearray((tmp_path / "a.vdif").read_bytes())
    size = len(raw) // 25
    raw[3 * size : 4 * size] = bytes(size)
    (tmp_path / "b.vdif").write_bytes(bytes(raw) + bytes(2 * size + 40))
    for payload in ("true", "false"):
        for per in ("2", "100"):
            rows = vdif.read_frames(spark, [f"{tmp_path}/b.vdif"], payload=payload, frames_per_partition=per).orderBy("offset").collect()
            assert [r.complete for r in rows] == [i not in (3, 25, 26, 27) for i in range(28)]
    (tmp_path / "c.vdif").write_bytes(bytes(1000))
    with pytest.raises(Exception, match="frame length 0"):
        vdif.read_frames(spark, [f"{tmp_path}/c.vdif"]).collect()


@given(st.sampled_from([1, 2, 4, 8]), st.data())
@settings(deadline=None, max_examples=20)
def test_bytes_from_the_top_down(bits, data):
    x = data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=100))
    assert vdif.unpack(vdif.pack(np.array(x, np.uint8), bits, msb_first=True), bits, msb_first=True)[: len(x)].tolist() == x


def test_named_files(spark, tmp_path):
    from fringeline.sources.folders import write_files, write_parts

    rows = spark.createDataFrame([(f"f{i % 3}", i, bytearray([i])) for i in range(30)], "file string, i int, body binary").repartition("file").sortWithinPartitions("file", "i")
    write_files(rows, str(tmp_path / "x"))
    assert {p.name: list(p.read_bytes()) for p in (tmp_path / "x").iterdir()} == {f"f{k}": list(range(k, 30, 3)) for k in range(3)}
    from pyspark.sql import functions as F

    write_parts(rows, [F.col("i")], str(tmp_path / "y"), parts=4)
    assert [b for p in sorted((tmp_path / "y").iterdir()) for b in p.read_bytes()] == list(range(30))


INI = {
    "correlation": "[elements]\nstations = 2\n[computation]\nFFT = 16\naccumulation = 1/4\nwindow = square\nphase_calibration = yes\n[times]\nmjd_start = 57350\nseconds_start = 100\nseconds_duration = 0.5\n",
    "stations": "[A]\nid = 0\nclock_ref = 57350\nclock_poly_us = 1:0\n[B]\nid = 1\nclock_poly_us = 0:0\nclock_ref = 57350\n",
    "sources": "[S]\nid = 0\n",
    "media": "[channels]\nCH0 = 0\n[frequencies]\nF0 = 1e6\n[polarizations]\nX = 0\n[sidebands]\n[files]\nlist = a.vdif, b.vdif\n[a.vdif]\nstation = A\nchannels = CH0\npolarizations = X\nfrequencies = F0\nsidebands = U\nf_sample = 1280\nbits_sample = 2\n[b.vdif]\nstation = B\nchannels = CH0\npolarizations = X\nfrequencies = F0\nsidebands = U\nf_sample = 1280\n",
    "delay_model": "[57350-0-200-so0-st0]\ndelay_us = 5,0,0,0,0,0\n[57350-0-200-so0-st1]\ndelay_us = 7,0,0,0,0,0\n",
}


def test_experiment_files(spark, tmp_path):
    for name, text in INI.items():
        (tmp_path / f"{name}.ini").write_text(text)
    e = E.load(spark, str(tmp_path))
    assert (e.fft_size, e.period, e.blocks, e.calibration) == (16, 0.25, 2, True)
    assert E.media_table(spark, e).count() == 2 and E.clock_table(spark, e).count() == 2
    assert [r.coeffs[0] for r in E.delay_table(spark, e).orderBy("station").collect()] == pytest.approx([5e-6, 7e-6])
    assert E.ini_table(spark, [f"{tmp_path}/sources.ini"]).first().value == "0"


def test_importers():
    s = E.stations_from_input("TELESCOPE NAME 0:   AA\nCLOCK REF MJD 0:   57000.5\nCLOCK COEFF 0/0:  1.5\nCLOCK COEFF 0/1:  2e-3\n")
    assert s == {"AA": {"id": 0, "clock_ref": 57000.5, "clock_us": [1.5, 0.002]}}
    assert E.bands_from_input("FREQ (MHZ) 0: 100.0\nBW (MHZ) 0: 32.0\nSIDEBAND 0: L\n") == [(0, 100e6, 32e6, "L")]
    assert E.correlation_from_input("INT TIME (SEC): 0.5\nSTART MJD: 57350\n") == {"period": 0.5, "mjd_start": 57350.0}
    im = "INTERVAL (SECS): 120\nSCAN 0 POINTING SRC: QSO\nSCAN 0 POLY 0 MJD: 57350\nSCAN 0 POLY 0 SEC: 60\nSRC 0 ANT 0 DELAY (us): 1.0 2.0 3.0\n"
    assert E.sources_from_im(im) == {"QSO": 0}
    assert E.delays_from_im(im) == [(57350, 60.0, 180.0, "QSO", 0, [1.0, 2.0, 3.0])]


def test_importer_keeps_some_sources():
    two = IM + "SCAN 1 POINTING SRC: STAR\nSCAN 1 POLY 0 MJD: 57350\nSCAN 1 POLY 0 SEC: 180\nSRC 1 ANT 0 DELAY (us): 7.0\n"
    assert {d[3] for d in E.delays_from_im(two)} == {"QSO", "STAR"}
    assert {d[3] for d in E.delays_from_im(two, ["STAR"])} == {"STAR"}
    assert all("-so1-" in k for k in E.delay_model_ini(two, ["STAR"]))


def test_dry_and_wet_parts(spark, tmp_path):
    im = IM + "SRC 0 ANT 0 DRY (us): 0.5 0.25\nSRC 0 ANT 0 WET (us): 0.125 0.0\n"
    made = E.delay_model_ini(im)
    section = next(k for k in made if k.endswith("-st0"))
    assert made[section]["dry_us"] == "0.5,0.25" and made[section]["wet_us"] == "0.125,0.0" and all("dry_us" not in v for k, v in made.items() if k != section)
    text = dict(INI)
    text["delay_model"] = E.ini_text(made)
    e = E.experiment(*(E.parse_ini(text[n]) for n in E.NAMES))
    parts = {r.part: r.coeffs for r in E.atmosphere_table(spark, e).collect()}
    assert parts["dry"] == pytest.approx([5e-7, 2.5e-7]) and parts["wet"] == pytest.approx([1.25e-7, 0.0]) and len(e.delays) == len(made)


def test_delay_table_file(spark, tmp_path):
    from fringeline.operators import delays

    blocks = spark.createDataFrame([(j, 57350, 95.0 + 68160 + j) for j in range(3)], "block int, mjd int, sec double")
    sections = spark.createDataFrame([(57350, 68160.0, 68280.0, 0, s, [1e-2 - s * 1e-3, 1e-7 * s, 1e-12]) for s in range(2)], "mjd int, start_s double, end_s double, source_id int, station int, coeffs array<double>")
    clocks = spark.createDataFrame([("A", 0, 57350.0, 1e-6, 0.0), ("B", 1, 57350.0, 2e-6, 1e-12)], "name string, station int, clock_ref double, c0 double, c1 double")
    polys = delays.relative(delays.block_polynomials(blocks, sections, clocks))
    E.write_delays_ini(polys, f"{tmp_path}/delays.ini")
    got = E.parse_ini((tmp_path / "delays.ini").read_text())
    assert set(got) == {"st0-so0", "st1-so0"} and all(len(v) == 3 * 16 for v in got.values())
    for r in polys.collect():
        own = got[f"st{r.station}-so0"]
        value = lambda key: float(own[f"{key}{int(r.sec)}"])  # noqa: E731, B023
        assert value("a.") == r.q0 + r.k0 and value("m.") == r.q0 and value("c.") == value("c0.") == r.k0 and value("d1.") == r.d1 and value("r.") == r.rel
        assert value("dr.") == r.sec and value("cr.") == pytest.approx(r.sec) and value("z0.") == 1e-6 and value("z1.") == 0.0
        assert value("dd.") == pytest.approx(r.f - (1e-2 + 1e-12 * (95 + r.block) ** 2 + 1e-6), abs=1e-15)
        assert own[f"si.{int(r.sec)}"] == f"57350-68160.0-68280.0-so0-st{r.station}"



INPUT = """DELAY FILENAME:     x.im
START MJD:          57350
START SECONDS:      68255
EXECUTE TIME (SEC): 3
INT TIME (SEC):     1.0
NUM CHANNELS:       128
FREQ (MHZ) 0:       3480.4
BW (MHZ) 0:         32.0
SIDEBAND 0:         L
FREQ (MHZ) 1:       3512.4
BW (MHZ) 1:         32.0
SIDEBAND 1:         L
FREQ (MHZ) 2:       3460.0
BW (MHZ) 2:         8.0
SIDEBAND 2:         U
TELESCOPE NAME 0:   AA
CLOCK REF MJD 0:    57000.5
CLOCK COEFF 0/0:    1.5
CLOCK COEFF 0/1:    2e-3
TELESCOPE NAME 1:   BB
CLOCK REF MJD 1:    57000.5
CLOCK COEFF 1/0:    0
TELESCOPE INDEX:    0
DATA SAMPLING:      REAL
PHASE CAL INT (MHZ):5
REC FREQ INDEX 0:   0
REC FREQ INDEX 1:   1
REC BAND 0 POL:     X
REC BAND 0 INDEX:   0
REC BAND 1 POL:     Y
REC BAND 1 INDEX:   1
TELESCOPE INDEX:    1
DATA SAMPLING:      REAL
PHASE CAL INT (MHZ):5
REC FREQ INDEX 0:   0
REC FREQ INDEX 1:   1
REC BAND 0 POL:     X
REC BAND 0 INDEX:   0
REC BAND 1 POL:     Y
REC BAND 1 INDEX:   1
FILE 0/0:           /data/a.vdif
FILE 1/0:           /data/b.vdif
"""
IM = """INTERVAL (SECS): 120
SCAN 0 POINTING SRC: QSO
SCAN 0 POLY 0 MJD: 57350
SCAN 0 POLY 0 SEC: 68160
SRC 0 ANT 0 DELAY (us): 1.0 2.0 3.0
SRC 0 ANT 1 DELAY (us): 4.0 5.0 6.0
"""


def test_imported_experiments_load(spark, tmp_path):
    from fringeline import cli

    (tmp_path / "x.input").write_text(INPUT)
    (tmp_path / "x.im").write_text(IM)
    cli.main(["import", "--input", f"{tmp_path}/x.input", "--im", f"{tmp_path}/x.im", "--output", f"{tmp_path}/e"])
    e = E.load(spark, f"{tmp_path}/e")
    assert (e.fft_size, e.period, e.mjd_start, e.start, e.blocks, e.calibration) == (128, 1.0, 57350, 68255.0, 3, True)
    assert e.stations["AA"] == {"id": 0, "clock_ref": 57000.5, "clock_us": [1.5, 0.002]} and e.sources == {"QSO": 0}
    assert [(m["name"], m["station"], m["channel"], m["pol"], m["freq_hz"], m["sideband"], m["fs"], m["f_pcal"]) for m in E.media_table(spark, e).orderBy("name", "idx").collect()][:2] == [("a.vdif", 0, 0, 0, 3480.4e6, "L", 64e6, 5e6), ("a.vdif", 0, 1, 1, 3512.4e6, "L", 64e6, 5e6)]
    assert [r.coeffs for r in E.delay_table(spark, e).orderBy("station").collect()] == [pytest.approx([1e-6, 2e-6, 3e-6]), pytest.approx([4e-6, 5e-6, 6e-6])]
    media = E.parse_ini((tmp_path / "e" / "media.ini").read_text())
    assert [tuple(r) for r in E.zoom_table(spark, media).collect()] == [(0, 3460e6, 8e6)]


def test_changed_values_and_unknown_formats(spark, tmp_path):
    for name, text in INI.items():
        (tmp_path / f"{name}.ini").write_text(text)
    e = E.load(spark, str(tmp_path), {"correlation.computation.FFT": "32", "media.a.vdif.f_sample": "2560"})
    assert e.fft_size == 32 and e.media["a.vdif"]["f_sample"] == "2560"
    with pytest.raises(ValueError, match="MARK5B"):
        E.load(spark, str(tmp_path), {"media.a.vdif.format": "MARK5B"})


def test_delay_rows_as_ini(spark):
    df = spark.createDataFrame([(0, 1, 5.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)], "source_id int, station int, sec double, rel double, d0 double, d1 double, d2 double, k0 double, k1 double, q0 double, f double")
    rows = {(r.section, r.key): r.value for r in E.delays_ini(df).collect()}
    assert rows["st1-so0", "r.5"] == "1.0" and rows["st1-so0", "a.5"] == "12.0" and rows["st1-so0", "dr.5"] == "5.0" and rows["st1-so0", "c.5"] == "5.0" and len(rows) == 11  # those whose columns are there


def test_states_as_of(spark):
    from fringeline.operators import delays

    states = spark.createDataFrame([(0, 10.0, "a"), (0, 20.0, "b"), (1, 0.0, "c")], "station int, since double, what string")
    rows = spark.createDataFrame([(0, 9.0), (0, 10.0), (0, 25.0), (1, 5.0), (2, 5.0)], "station int, t double")
    got = {(r.station, r.t): r.what for r in delays.asof(rows, states, ("station",), "t", "since").collect()}
    assert got == {(0, 9.0): None, (0, 10.0): "a", (0, 25.0): "b", (1, 5.0): "c", (2, 5.0): None}


def test_synthetic_streams(spark, tmp_path):
    """Two stations see the same sky seven samples apart, in two bands, with tones."""
    from fringeline.operators import align, fx
    from fringeline.sources import synthetic

    s = synthetic.Signal(fs=6400.0, spf=64, seconds=2, channels=2, noise=0.3, tone=0.5, f_pcal=400.0)
    synthetic.write(spark, s, {0: 0, 1: 7}, str(tmp_path))
    frames = vdif.with_time(vdif.read_folder(spark, str(tmp_path)), 6400.0).selectExpr("*", "station_code station", "CAST(6400 AS DOUBLE) fs")
    assert frames.count() == 2 * 2 * 100
    polys = spark.createDataFrame([(b, 0, st, 7 * st / 6400, 7 * st / 6400, 0.0, 0.0) for b in range(2) for st in range(2)], "block int, source_id int, station int, rel double, d0 double, d1 double, d2 double")
    media = spark.createDataFrame([(st, i, i, 0, 0.0, "U", 400.0) for st in range(2) for i in range(2)], "station int, idx int, channel int, pol int, freq_hz double, sideband string, f_pcal double")
    chunks = align.chunks(align.aligned(frames, polys, start=0.0, period=1.0, blocks=2), media)
    vis = fx.correlate(chunks, fft_size=32, period=1.0).where("sp0 = 0 AND sp1 = 2")
    for c in range(2):
        assert abs(sum(complex(v.re, v.im) for v in vis.where(f"acc = 0 AND channel = {c}").collect())) > 0.5
    tones = fx.calibration(chunks).where("acc = 0 AND channel = 0 AND sp = 0").orderBy("k").collect()
    size = np.abs([complex(t.re, t.im) for t in tones])
    assert len(size) == 16 and size[1:8].min() > 1
    quiet = synthetic.noise((3, 1), -10, 9000)
    assert np.array_equal(quiet[4000:5000], synthetic.noise((3, 1), 3990, 1000))


def test_filter_bank():
    from fringeline.sources.synthetic import filter_bank

    n, channels = 4096, 4
    rows = filter_bank(np.cos(2 * np.pi * (2 * n // 8 + 37) * np.arange(n) / n), channels)  # in the third band
    power = (rows**2).sum(1)
    assert rows.shape == (4, n // 4) and power.argmax() == 2 and power[2] > 100 * np.delete(power, 2).max()
    assert np.abs(np.fft.rfft(rows[2])).argmax() == 37
