"""Growing files, files of any store, time-pruned ranges, and the correlator of a stream."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeline.operators import align, fx
from fringeline.plans import correlation, views
from fringeline.sources import vdif
from fringeline.streaming import correlator

SF = "/root/testdata/sf0.001"


def frames_of(count, first=0, per=4, station=3):
    r = np.random.default_rng(7)
    return [vdif.frame(r.integers(0, 4, 64), bits=2, seconds=100 + i // per, frame_num=i % per, station_code=station, epoch=30) for i in range(first, first + count)]


def rows(df):
    return sorted((os.path.basename(r.file), r.offset, r.seconds, r.frame_num, r.complete, bytes(r.payload)) for r in df.collect())


def test_growing_files_are_read_once(spark, tmp_path):
    folder, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    all_ = frames_of(10)
    steps = [  # bytes appended to a and to b before each run; a frame is cut in two between the runs
        (b"".join(all_[:3]) + all_[3][:20], b""),
        (all_[3][20:] + all_[4], all_[0][:10]),
        (b"".join(all_[5:]), all_[0][10:] + all_[1]),
    ]
    seen = []
    for a, b in steps:
        for name, raw in (("a.vdif", a), ("b.vdif", b)):
            with open(folder / name, "ab") as f:
                f.write(raw)
        stream = vdif.stream_frames(spark, str(folder), frames_per_partition="2")
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(spark.read.schema(vdif.SCHEMA).parquet(sink).count())
    assert seen == [3, 5, 12]
    assert rows(spark.read.schema(vdif.SCHEMA).parquet(sink)) == rows(vdif.read_folder(spark, str(folder)))


def test_files_of_any_store(spark, tmp_path):
    for name, count in (("a.vdif", 40), ("b.vdif", 7)):
        (tmp_path / name).write_bytes(b"".join(frames_of(count)))
    long = [vdif.frame(np.zeros(256, int), bits=2, seconds=100 + i, frame_num=0, station_code=1, epoch=30) for i in range(3)]
    (tmp_path / "c.vdif").write_bytes(b"".join(long) + long[0][:50] )
    (tmp_path / "d.vdif").write_bytes(b"".join(long))
    (tmp_path / "_e").write_bytes(b"x" * 100)
    want = rows(vdif.read_frames(spark, [f"{tmp_path}/{n}.vdif" for n in "abcd"]))
    assert rows(vdif.read_records(spark, [f"file://{tmp_path}/*"])) == want
    early = vdif.read_records(spark, [f"file://{tmp_path}/*"], t_end="102", payload="false")
    assert early.count() == sum(w[2] < 102 for w in want) and early.agg(F.max(F.length("payload"))).first()[0] == 0
    assert vdif.read_records(spark, [f"file://{tmp_path}/none*"]).count() == 0


def test_records_split_by_the_store(spark, tmp_path):
    """Splits much smaller than the file, whose borders are no frame's."""
    (tmp_path / "a.vdif").write_bytes(b"".join(frames_of(5000)))
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "5000")
    try:
        df = vdif.read_records(spark, [f"file://{tmp_path}/a.vdif"])
        assert df.rdd.getNumPartitions() > 10
        assert rows(df) == rows(vdif.read_frames(spark, [f"{tmp_path}/a.vdif"]))
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")


@pytest.mark.parametrize("damaged", [False, True])
def test_ranges_outside_the_scan_are_not_opened(spark, tmp_path, damaged):
    path = f"{tmp_path}/a.vdif"
    body = frames_of(40_000)
    if damaged:
        body[20_000:20_003] = [b"\0" * len(body[0])] * 3
    with open(path, "wb") as f:
        f.write(b"".join(body))
    options = {"path": path, "ordered": "true", "slack": "100", "t_start": str(100 + 5000), "t_end": str(100 + 5100)}
    reader = vdif.VdifReader(options)
    read = sum(p.end - p.first for p in reader.partitions())
    assert read <= 0.03 * os.path.getsize(path)
    some = {k: v for k, v in options.items() if k != "path"}
    pruned, plain = vdif.read_frames(spark, [path], **some), vdif.read_frames(spark, [path], **{k: v for k, v in some.items() if k.startswith("t_")})
    assert rows(pruned) == rows(plain) and pruned.count() == (397 if damaged else 400)  # a zeroed header has no time
    # the same bounds as days
    mjd = vdif.epoch_mjd(30)
    scan = vdif.read_frames(spark, [path], ordered="true", scan_start=f"{mjd}:5100", scan_end=f"{mjd}:5200")
    assert rows(scan) == rows(plain)
    assert vdif.read_frames(spark, [path], ordered="true", t_start="1000000").count() == 0


def test_a_file_that_ends_in_a_header(spark, tmp_path):
    (tmp_path / "a.vdif").write_bytes(b"".join(frames_of(2)) + b"\1" * 20)
    got = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"]).orderBy("offset").collect()
    assert [r.complete for r in got] == [True, True, False] and got[2].offset == 2 * 48


def test_skipped_bytes(spark, tmp_path):
    (tmp_path / "a.vdif").write_bytes(b"?" * 13 + b"".join(frames_of(5)))
    got = vdif.read_frames(spark, [f"{tmp_path}/a.vdif"], skip_bytes="13", frames_per_partition="2").orderBy("offset").collect()
    assert [(r.offset, r.frame_num, r.complete) for r in got] == [(13 + 48 * i, i % 4, True) for i in range(5)]


def test_invalid_frames_go_on_demand(spark):
    frames = views.frames(spark, SF).withColumn("invalid", F.col("t") % 5 == 0)
    model = views.frame_model(spark)
    count = lambda **o: align.aligned(frames, model, start=0.0, period=views.PERIOD, blocks=views.BLOCKS, **o).count()
    assert count(drop_invalid=True) == count() - frames.where("invalid").count()


def values(vis):
    return {(r.acc, r.channel, r.sp0, r.sp1, r.k): (r.n_windows, r.re, r.im) for r in vis.collect()}


@pytest.mark.parametrize("cuts", [(500,), (30, 77, 500), (11, 12, 13, 60, 500)])
@pytest.mark.parametrize("lost", ["false", correlation.LOST_FRAMES])
def test_stream_correlator_is_the_batch(spark, tmp_path, cuts, lost):
    frames, folder = views.frames(spark, SF), f"{tmp_path}/in"
    os.mkdir(folder)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    chunks = align.chunks(align.aligned(stream, views.frame_model(spark), start=0.0, period=views.PERIOD, blocks=views.BLOCKS), views.frame_media(spark))
    first, late = 0, 0
    for n, end in enumerate(cuts):  # each run starts anew from the checkpoint
        frames.where(f"t >= {first} AND t < {end} AND NOT ({lost})").coalesce(1).write.mode("append").parquet(folder)
        if end == cuts[-1]:
            for t in (views.PERIOD * views.BLOCKS - 1, 3.0):  # a frame far on closes all blocks; one is too late then
                frames.limit(1).withColumn("t", F.lit(t)).coalesce(1).write.mode("append").parquet(folder)
        out = correlator.correlated_stream(chunks, fft_size=32, period=views.PERIOD, start=1.7e9, streams=4)
        late += correlator.late_rows(correlator.written_stream(out, f"{tmp_path}/out", f"{tmp_path}/mark"))
        first = end
    got = values(correlator.visibilities(correlator.read_written(spark, f"{tmp_path}/out")))
    want = values(fx.correlate(correlation.frame_chunks(spark, SF, lost), fft_size=32, period=views.PERIOD))
    assert late == 1 and got.keys() == want.keys() and len(got) > 500
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], atol=1e-12) for k in got)


def test_samples_that_wait_for_nothing_never_enter_the_state(spark, tmp_path):
    """Blocks that come whole leave their sums, the number of windows, a timer and the chunks at their ends; storing each chunk takes more puts than there are frames."""
    frames, folder = views.frames(spark, SF), f"{tmp_path}/in"
    frames.where("t < 300").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(frames.schema).parquet(folder)
    chunks = align.chunks(align.aligned(stream, views.frame_model(spark), start=0.0, period=views.PERIOD, blocks=views.BLOCKS), views.frame_media(spark))
    out = correlator.correlated_stream(chunks, fft_size=32, period=views.PERIOD, start=1.7e9, streams=4, late="100000 seconds")
    (p,) = [p for p in correlator.written_stream(out, f"{tmp_path}/out", f"{tmp_path}/mark") if p["batchId"] == 0]
    (state,) = p["stateOperators"]
    assert state["numRowsTotal"] > 0 and state["customMetrics"]["rocksdbPutCount"] < 250 < frames.count() / 2 + 1
