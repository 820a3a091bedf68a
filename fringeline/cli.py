"""Command line: correlate an experiment, look into frame files, compare, zoom, export and import.

    python -m fringeline.cli correlate --experiment DIR --media DIR --output DIR [--ordered] [--set FILE.SECTION.KEY=VALUE ...]
    python -m fringeline.cli vdif-info FILE... [--skip N] [--limit N] [--summary]
    python -m fringeline.cli compare DIR DIR [--most X]
    python -m fringeline.cli zoom DIR --channels f:bw,... --zooms f:bw,... --fft N --average N --output DIR [--periods N,...]
    python -m fringeline.cli export RESULTS --experiment DIR --output DIR [--conjugate] [--divide X]
    python -m fringeline.cli text RESULTS --experiment DIR --output DIR
    python -m fringeline.cli import --input FILE --im FILE --output DIR [--source NAME ...]
"""

from __future__ import annotations

import argparse
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fringeline.operators import align, delays, fx, post
from fringeline.sources import experiment as ex
from fringeline.sources import results, vdif
from fringeline.sources.folders import local_path, removed, shared_folder


#: Seconds beside the scan within which frames are read; delays are well below.
MARGIN = 2


def frames_of(spark: SparkSession, e: ex.Experiment, media_dir: str, *, ordered: bool = False, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames of all media files with station, fs and time (from the scan's first midnight on), and the media table.

    ordered: the files' frames rise in time, so that only ranges of the scan are opened.  counts takes what frames there were.
    """
    media = ex.media_table(spark, e)
    files = media.select("name", "station", "fs").distinct()
    scan = {"ordered": "true", "scan_start": f"{e.mjd_start}:{e.start - MARGIN}", "scan_end": f"{e.mjd_start}:{e.start + e.blocks * e.period + MARGIN}"} if ordered else {}
    frames = vdif.read_frames(spark, [f"{media_dir}/{n}" for n in e.media], **scan)
    if counts is not None:
        frames = fx.counted(frames, counts)
    named = ex.described(frames.withColumn("name", F.element_at(F.split("file", "/"), -1)), files, "name")
    return vdif.with_time(named, F.col("fs"), mjd_start=e.mjd_start), media


def chunks_of(spark: SparkSession, e: ex.Experiment, media_dir: str, **options) -> DataFrame:
    frames, media = frames_of(spark, e, media_dir, **options)
    polys = delays.relative(delays.block_polynomials(ex.block_table(spark, e), ex.delay_table(spark, e), ex.clock_table(spark, e)))
    return align.chunks(align.aligned(frames, polys, start=e.start, period=e.period, blocks=e.blocks), media)


def correlated(chunks: DataFrame, e: ex.Experiment) -> dict[str, DataFrame]:
    """Visibilities, stream statistics, dismissed streams' blocks and, if asked for, calibration tones of aligned chunks."""
    most = 2 * max(x["id"] for x in e.stations.values()) + 2
    streams = len({(e.stations[m["station"]]["id"], p) for m in e.media.values() for p in m["polarizations"]})
    summary = fx.stream_summary(chunks)
    out = {
        "visibilities": fx.correlate(chunks, fft_size=e.fft_size, period=e.period, hanning=e.window == "hanning", autos=e.autos, cross_polarisation=e.cross_polarisation, streams=most),
        "statistics": fx.statistics_of(summary),
        "dismissed": fx.dismissed(summary, streams),
        "metadata": results.metadata_of(summary, period=e.period),
    }
    return out | {"calibration": fx.calibration(chunks)} if e.calibration else out


def exported(spark: SparkSession, e: ex.Experiment, folder: str, output: str, *, conjugate: bool = False, divide: float = 1.0) -> None:
    vis = spark.read.parquet(f"{folder}/visibilities")
    media = ex.media_table(spark, e)
    bands = media.groupBy("channel").agg(F.max("freq_hz").alias("f"), (F.max("fs") / 2).alias("bw"), F.max("f_pcal").alias("f_pcal"))  # of real samples
    tones = spark.read.parquet(f"{folder}/calibration") if e.calibration else None
    if tones is not None:
        size = tones.groupBy("channel").agg((F.max("k") + 1).alias("n"))
        bands = bands.where("f_pcal > 0").join(size, "channel")
    first = bands.first()
    results.export(vis, tones if first else None, bands, ex.clock_table(spark, e).select("station", "name"), output, mjd=e.mjd_start, start=e.start, period=e.period, n_bands=media.select("channel", "pol").distinct().count(), n_tones=int(-(-first["bw"] // first["f_pcal"])) if first and tones is not None else 0, conjugate=conjugate, divide=divide)


def bands(text: str, name: str, spark: SparkSession) -> DataFrame:
    rows = [(i, *map(float, part.split(":"))) for i, part in enumerate(text.split(","))]
    return spark.createDataFrame(rows, f"{name} int, f double, bw double")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    c = sub.add_parser("correlate")
    c.add_argument("--experiment", required=True)
    c.add_argument("--media", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--ordered", action="store_true")
    i = sub.add_parser("vdif-info")
    i.add_argument("files", nargs="+")
    i.add_argument("--skip", type=int, default=0)
    i.add_argument("--limit", type=int, default=20)
    i.add_argument("--summary", action="store_true")
    d = sub.add_parser("compare")
    d.add_argument("a")
    d.add_argument("b")
    d.add_argument("--most", type=float)
    z = sub.add_parser("zoom")
    z.add_argument("results")
    z.add_argument("--channels", required=True)
    z.add_argument("--zooms", required=True)
    z.add_argument("--fft", type=int, required=True)
    z.add_argument("--average", type=int, default=1)
    z.add_argument("--periods")
    z.add_argument("--output", required=True)
    e = sub.add_parser("export")
    t = sub.add_parser("text")
    for p in (e, t):
        p.add_argument("results")
        p.add_argument("--experiment", required=True)
        p.add_argument("--output", required=True)
    e.add_argument("--conjugate", action="store_true")
    e.add_argument("--divide", type=float, default=1.0)
    for p in (c, e, t):
        p.add_argument("--set", action="append", default=[], metavar="FILE.SECTION.KEY=VALUE")
    m = sub.add_parser("import")
    m.add_argument("--input", required=True)
    m.add_argument("--im", required=True)
    m.add_argument("--source", action="append")
    m.add_argument("--output", required=True)
    return parser


def main(args: list[str] | None = None) -> None:
    a = arguments().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    e = ex.load(spark, a.experiment, dict(x.split("=", 1) for x in a.set)) if "experiment" in a else None
    if a.what == "correlate":
        own = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"  # read by all results, so frames are read once
        try:
            counts = Observation("frames")
            chunks_of(spark, e, a.media, ordered=a.ordered, counts=counts).write.parquet(own)
            spark.createDataFrame([tuple(counts.get.values())], ", ".join(f"{c} long" for c in counts.get)).write.mode("overwrite").parquet(str(Path(a.output) / "counts"))
            for name, df in correlated(spark.read.parquet(own), e).items():
                df.write.mode("overwrite").parquet(str(Path(a.output) / name))
        finally:
            removed(spark, own)
    elif a.what == "vdif-info":
        frames = vdif.read_frames(spark, a.files, payload="false")
        shown = vdif.file_summary(frames) if a.summary else vdif.listing(frames.drop("payload"), ("file", "offset"), skip=a.skip, limit=a.limit)
        shown.show(a.limit, truncate=False)
    elif a.what == "compare":
        found = post.difference(spark.read.parquet(a.a), spark.read.parquet(a.b))
        found.show()
        r = found.first()
        if a.most is not None and (r["unmatched"] or r["difference"] > a.most):
            raise SystemExit(f"{r['unmatched']} coefficients are in one result only, and the difference is {r['difference']}")
    elif a.what == "zoom":
        periods = [int(x) for x in a.periods.split(",")] if a.periods else None
        found = post.zoom(spark.read.parquet(a.results), bands(a.channels, "channel", spark), bands(a.zooms, "zoom", spark), a.fft, periods=periods)
        post.averaged(found, a.average, ("acc", "zoom", "band", "sp0", "sp1")).write.mode("overwrite").parquet(a.output)
    elif a.what == "export":
        exported(spark, e, a.results, a.output, conjugate=a.conjugate, divide=a.divide)
    elif a.what == "text":
        meta = spark.read.parquet(f"{a.results}/metadata")
        channels = ex.media_table(spark, e).agg(F.max("channel")).first()[0] + 1
        lines = results.text_lines(results.spectra_rows(spark.read.parquet(f"{a.results}/visibilities")), channels, meta)
        if e.calibration:
            lines = lines.unionByName(results.tone_lines(spark.read.parquet(f"{a.results}/calibration"), channels, meta))
        lines.write.mode("overwrite").text(a.output)
    else:
        read = lambda p: spark.read.text(p, wholetext=True).first()[0]
        out = Path(local_path(a.output))
        out.mkdir(parents=True, exist_ok=True)
        for name, text in ex.imported(read(a.input), read(a.im), a.source).items():
            (out / f"{name}.ini").write_text(text)


if __name__ == "__main__":
    main()
