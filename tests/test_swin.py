"""Binary result records: filters of the reader, one merged file, conjugate and divided coefficients."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeline.sources import results
from fringeline.sources.folders import merged

N = 4


def records(spark, periods=6):
    rows = [(acc, band, st0, p0, st1, p1, 1, [float(acc + k) for k in range(N)], [float(band - k) for k in range(N)]) for acc in range(periods) for band in range(3) for st0, st1 in ((0, 0), (0, 1), (1, 1)) for p0 in range(2) for p1 in range(2)]
    return spark.createDataFrame(rows, "acc int, channel int, st0 int, pol0 int, st1 int, pol1 int, n_windows long, re array<double>, im array<double>")


OPTIONS = {"mjd": 57350, "start": 86398.0, "period": 1.0}


def got(df):
    return sorted((r.mjd, r.seconds, r.st0, r.st1, r.band, r.pols, tuple(r.re), tuple(r.im)) for r in df.collect())


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('swin')}/all"
    results.write_swin_file(records(spark), path, parts=5, **OPTIONS)
    return path


def test_one_file_is_the_parts_end_to_end(spark, file, tmp_path):
    parts = sorted(f for f in os.listdir(f"{file}.parts") if f.startswith("part-"))
    raw = b"".join(open(f"{file}.parts/{p}", "rb").read() for p in parts)
    assert len(parts) > 1 and open(file, "rb").read() == raw and len(raw) == 6 * 3 * 12 * (74 + 8 * N)
    merged(spark, f"{file}.parts", f"{tmp_path}/again", piece=100)  # pieces smaller than a record
    assert open(f"{tmp_path}/again", "rb").read() == raw
    os.mkdir(tmp_path / "none")
    merged(spark, str(tmp_path / "none"), f"{tmp_path}/empty")
    assert os.path.getsize(f"{tmp_path}/empty") == 0


def test_reader_by_blocks(spark, file, monkeypatch):
    whole = got(results.read_swin(spark, file, N))
    assert len(whole) == 6 * 36 and whole[0][:2] == (57350, 86398.5) and whole[-1][:2] == (57351, 3.5)
    monkeypatch.setattr(results.SwinReader, "BLOCK", 250)
    assert got(results.read_swin(spark, file, N, records_per_partition="7")) == whole


@pytest.mark.parametrize("options, keep", [
    ({"bands": "0,2"}, lambda r: r[4] in (0, 2)),
    ({"pols": "XX,YX"}, lambda r: r[5] in ("XX", "YX")),
    ({"t_start": "57350:86399", "t_end": "57351:2"}, lambda r: 86399 <= (r[0] - 57350) * 86400 + r[1] < 86402),
    ({"bands": "1", "pols": "YY", "t_start": "57351:0"}, lambda r: r[4] == 1 and r[5] == "YY" and r[0] == 57351),
    ({"bands": "9"}, lambda r: False),
])
def test_filters(spark, file, options, keep):
    whole = got(results.read_swin(spark, file, N))
    assert got(results.read_swin(spark, file, N, **options)) == [r for r in whole if keep(r)]


def test_limit_does_not_open_what_follows(spark, file):
    first = results.read_swin(spark, file, N, skip="5", limit="10", records_per_partition="4")
    assert first.count() == 10
    reader = results.SwinReader({"path": file, "coefficients": str(N), "skip": "5", "limit": "10", "records_per_partition": "4"})
    assert [(p.first, p.count) for p in reader.partitions()] == [(5, 4), (9, 4), (13, 2)]


def test_conditions_reach_the_reader(spark, file):
    spark.conf.set(results.PUSH, "true")
    try:
        df = results.read_swin(spark, file, N).where("band = 1 AND pols IN ('XX', 'YY')")
        assert got(df) == [r for r in got(results.read_swin(spark, file, N)) if r[4] == 1 and r[5] in ("XX", "YY")]
        assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().split("Scan")[0] or df.count() == 36
    finally:
        spark.conf.unset(results.PUSH)


def test_conjugate_and_divide(spark, tmp_path):
    one = records(spark, 1).where("channel = 0 AND st0 = 0 AND st1 = 1 AND pol0 = 0 AND pol1 = 1")
    results.write_swin(one, f"{tmp_path}/r", conjugate=True, divide=4.0, **OPTIONS)
    r = results.read_swin(spark, f"{tmp_path}/r", N).first()
    assert np.allclose(r.re, np.arange(N) / 4) and np.allclose(r.im, np.arange(N) / 4) and r.pols == "XY"
    assert results.read_swin(spark, f"{tmp_path}/r", N).agg(F.count("*")).first()[0] == 1
