"""Result files: text lines of visibilities and tones, SWIN binary records, calibration text files, and their readers.

Rows of visibilities are acc, channel, st0, pol0, st1, pol1, n_windows and the arrays re, im.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from fringeline.operators import post
from fringeline.operators.fx import stream_summary
from fringeline.operators.joins import dimension
from fringeline.sources.folders import local_path, merged, write_files, write_parts
from fringeline.sources.vdif import PUSH

# The SWIN record header, little-endian.
SWIN = "<4siiidiii2sid3d"
SYNC = b"\x00\xff\x00\xff"
SYNC_WORD = int.from_bytes(SYNC, "little")
# The header lines of a calibration file.
CALIBRATION_HEADER = ("# Pulse cal data", "# File version = 1", "# Start MJD = {mjd}", "# Start seconds = {start}", "# Telescope name = {station}")
INVALID_TONE = "-1 0 0 0"
#: Metadata of a text line, in order; the last one is not written.
METADATA = "st_pol shift frac abs_delay d0 d1 d2 d_ref c0 c1 z0 z1 c_ref model_only clock_only diff_frac num_samples fs bits first_sample data_type n_bins_pcal pcal_freq channel channel_freq acc_time encoding sideband".split()


def swin_name(mjd: int, start: float) -> str:
    return f"DIFX_{mjd}_{int(start)}.s0000.b0000"


def calibration_name(mjd: int, start: float, station: str) -> str:
    return f"PCAL_{mjd}_{int(start):06d}_{station}"


def baseline_number(st0: Column, st1: Column) -> Column:
    return (st0 + 1) * 256 + st1 + 1


def stations_of(number: Column) -> tuple[Column, Column]:
    return F.floor(number / 256).cast("int") - 1, (number % 256 - 1).cast("int")


def swin_order(vis: DataFrame) -> list[Column]:
    """Rows by time, autos last, then stations, polarisations and channel."""
    return [F.col("acc"), F.lit(1_000_000) - F.abs(F.col("st0") - F.col("st1")), F.col("st0"), F.col("st1"), F.col("pol0"), F.col("pol1"), F.col("channel")]


def numbered(vis: DataFrame) -> DataFrame:
    """vis with row_nr, from 1 on in the order of records; rows are numbered by period, periods hold what came before."""
    before = F.sum("n").over(Window.orderBy("acc").rowsBetween(Window.unboundedPreceding, -1))  # a row for each period
    offset = vis.groupBy("acc").agg(F.count("*").alias("n")).select("acc", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("acc").orderBy(*swin_order(vis)[1:]))
    return vis.withColumn("own", own).join(offset, "acc").withColumn("row_nr", F.col("own") + F.col("offset")).drop("own", "offset")


def spectra_rows(vis: DataFrame, keys: tuple[str, ...] = ("acc", "channel")) -> DataFrame:
    """Rows by coefficient (sp0, sp1, k, re, im, n_windows) as rows of visibilities."""
    v = F.array_sort(F.collect_list(F.struct("k", "re", "im")))
    rows = vis.groupBy(*keys, "sp0", "sp1").agg(F.max("n_windows").alias("n_windows"), v.alias("v"))
    part = lambda c: [F.floor(F.col(f"sp{c}") / 2).cast("int").alias(f"st{c}"), (F.col(f"sp{c}") % 2).cast("int").alias(f"pol{c}")]
    return rows.select(*keys, *part(0), *part(1), "n_windows", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def swin_record(mjd: int, seconds: float, st0: int, st1: int, band: int, pols: str, re: np.ndarray, im: np.ndarray, *, conjugate: bool = False, divide: float = 1.0) -> bytes:
    head = struct.pack(SWIN, SYNC, 1, 256 * (st0 + 1) + st1 + 1, mjd, seconds, 0, 0, band, pols.encode(), 0, 1.0, 0.0, 0.0, 0.0)
    body = np.empty(2 * len(re), "<f4")
    body[0::2], body[1::2] = np.asarray(re) / divide, np.asarray(im) / divide * (-1 if conjugate else 1)
    return head + body.tobytes()


def swin_records(vis: DataFrame, *, mjd: int, start: float, period: float, pols: str = "XY", conjugate: bool = False, divide: float = 1.0) -> DataFrame:
    """vis with the binary record (body) of each row; seconds are of the middle of the period, days go on after midnight."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                day, seconds = divmod(start + (r["acc"] + 0.5) * period, 86400)
                out.append(swin_record(mjd + int(day), seconds, r["st0"], r["st1"], r["channel"], pols[r["pol0"]] + pols[r["pol1"]], r["re"], r["im"], conjugate=conjugate, divide=divide))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "body"])

    return vis.mapInArrow(work, vis.withColumn("body", F.lit(b"")).schema)


def write_swin(vis: DataFrame, path: str, *, mjd: int, start: float, period: float, pols: str = "XY", conjugate: bool = False, divide: float = 1.0, parts: int | None = None) -> None:
    """Writes the sorted records as part files of the folder `path`, each by its own task; end to end they are one file."""
    rows = swin_records(vis, mjd=mjd, start=start, period=period, pols=pols, conjugate=conjugate, divide=divide)
    write_parts(rows, swin_order(rows), path, parts=parts)


def write_swin_file(vis: DataFrame, file: str, **options) -> None:
    """write_swin() into one file: the parts are written beside it by their tasks, and copied to their places in it by tasks too."""
    parts = f"{file}.parts"
    write_swin(vis, parts, **options)
    merged(vis.sparkSession, parts, file)


class SwinRange(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


SWIN_SCHEMA = "mjd int, seconds double, st0 int, st1 int, band int, pols string, re array<float>, im array<float>"
#: Fields of a record's head, as SWIN packs them.
SWIN_HEAD = [("sync", "<u4"), ("version", "<i4"), ("number", "<i4"), ("mjd", "<i4"), ("seconds", "<f8"), ("config", "<i4"), ("source", "<i4"), ("band", "<i4"), ("pols", "S2"), ("pulsar", "<i4"), ("weight", "<f8"), ("uvw", "<f8", 3)]


class SwinReader(DataSourceReader):
    """Records of equal coefficients of one file, or of the files of a folder, read in blocks and decoded together.

    Options: path, coefficients, records_per_partition, and what to keep: bands (numbers) and pols (pairs as XX), comma-separated,
    t_start and t_end (mjd:seconds; the middle of a period from the first on and before the second), skip and limit (of the
    records of each file, before the others; a file's records beyond them are not opened).
    """

    #: Bytes read at once.
    BLOCK = 4 << 20

    def __init__(self, options: dict[str, str]):
        path, n = local_path(options["path"]), int(options["coefficients"])
        self.paths = sorted(f"{path}/{f}" for f in os.listdir(path) if not f.startswith(".")) if os.path.isdir(path) else [path]
        self.per = int(options.get("records_per_partition", 10_000))
        self.kind = np.dtype([*SWIN_HEAD, ("v", "<f4", (n, 2))])
        self.skip, self.limit = int(options.get("skip", 0)), int(options["limit"]) if "limit" in options else None
        self.bands = {int(x) for x in options["bands"].split(",")} if "bands" in options else None
        self.pols = {x.strip().encode() for x in options["pols"].split(",")} if "pols" in options else None
        time = lambda c: float(options[c].split(":")[0]) * 86400 + float(options[c].split(":")[1]) if c in options else None
        self.low, self.high = time("t_start"), time("t_end")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            total = os.path.getsize(path) // self.kind.itemsize
            last = total if self.limit is None else min(total, self.skip + self.limit)
            out += [SwinRange(path, i, min(self.per, last - i)) for i in range(self.skip, last, self.per)]
        return out

    def read(self, part: SwinRange) -> Iterator[pa.RecordBatch]:
        step = max(1, self.BLOCK // self.kind.itemsize)
        with open(part.path, "rb") as f:
            f.seek(part.first * self.kind.itemsize)
            for at in range(0, part.count, step):
                rows = np.frombuffer(f.read(min(step, part.count - at) * self.kind.itemsize), self.kind)
                if (rows["sync"] != SYNC_WORD).any():
                    raise ValueError("no record here")
                yield self.decoded(rows[self.wanted(rows)])

    def wanted(self, rows: np.ndarray) -> np.ndarray:
        use = np.ones(len(rows), bool)
        if self.bands is not None:
            use &= np.isin(rows["band"], list(self.bands))
        if self.pols is not None:
            use &= np.isin(rows["pols"], list(self.pols))
        t = rows["mjd"] * 86400.0 + rows["seconds"]
        if self.low is not None:
            use &= t >= self.low
        if self.high is not None:
            use &= t < self.high
        return use

    def decoded(self, rows: np.ndarray) -> pa.RecordBatch:
        part = lambda i: pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * self.kind["v"].shape[0]).astype(np.int32)), pa.array(np.ascontiguousarray(rows["v"][:, :, i]).ravel()))
        columns = [rows["mjd"], rows["seconds"], rows["number"] // 256 - 1, rows["number"] % 256 - 1, rows["band"]]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(rows["pols"].astype(str).tolist(), pa.string()), part(0), part(1)], names=[c.split()[0] for c in SWIN_SCHEMA.split(", ")])


class FilteringSwinReader(SwinReader):
    """Also applies Spark's conditions on band and pols to the heads; the session's setting PUSH must be on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            own = {value} if isinstance(f, EqualTo) else set(value) if isinstance(f, In) else None
            if own is not None and column == ("band",):
                self.bands = own if self.bands is None else self.bands & own
            elif own is not None and column == ("pols",):
                own = {x.encode() for x in own}
                self.pols = own if self.pols is None else self.pols & own
            else:
                yield f


class SwinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "swin"

    def schema(self) -> str:
        return SWIN_SCHEMA

    def reader(self, schema) -> SwinReader:
        return (FilteringSwinReader if self.options.get("push") == "true" else SwinReader)(self.options)


def read_swin(spark: SparkSession, path: str, coefficients: int, **options: str) -> DataFrame:
    """Records of a file or folder; options as of SwinReader."""
    spark.dataSource.register(SwinSource)
    return spark.read.format("swin").options(path=path, coefficients=str(coefficients), push=spark.conf.get(PUSH, "false"), **options).load()


def metadata(chunks: DataFrame, *, period: float) -> DataFrame:
    """acc, channel, station, pol, meta (the written fields, joined by a blank) and first (sample and channel) of each stream's first chunk.

    The fields of calibration are 0, as in lines of visibilities; so are those that chunks do not carry.
    """
    return metadata_of(stream_summary(chunks), period=period)


def metadata_of(summary: DataFrame, *, period: float) -> DataFrame:
    """metadata() of the chunks that fx.stream_summary() was taken of."""
    one = summary.withColumnRenamed("head", "r")
    known = {
        "st_pol": F.concat_ws(".", F.col("station").cast("string"), F.col("pol").cast("string")), "num_samples": F.col("r.n_samples"), "data_type": F.when(F.col("r.is_complex"), "c").otherwise("r"),
        "channel": F.col("channel"), "channel_freq": F.col("r.freq_hz"), "acc_time": F.lit(period), "encoding": F.lit("U"), "abs_delay": F.col("r.d0"),
    } | {c: F.col(f"r.{c}") for c in ("shift", "frac", "d0", "d1", "d2", "fs", "bits", "first_sample")}
    fields = [known.get(c, F.lit(0)).cast("string") for c in METADATA[:-1]]
    return one.select(F.col("acc_block").alias("acc"), "channel", "station", "pol", F.concat_ws(" ", *fields).alias("meta"), F.concat_ws(".", F.col("r.first_sample").cast("string"), F.col("channel").cast("string")).alias("first"))


def line(kind: str, channels: int, numbers: Column) -> Column:
    """Key, a tab, the written metadata, first sample and channel, and the coefficients."""
    key = F.format_string(f"{kind}-%d.%d-%d.%d-a.%d.%d.%d-sxa%d", "st0", "pol0", "st1", "pol1", F.col("acc") * channels + F.col("channel"), "acc", "channel", "n_windows")
    blank = F.lit(" ".join(["0"] * (len(METADATA) - 1)))
    return F.concat(key, F.lit("\t"), F.concat_ws(" ", F.coalesce("meta", blank), F.coalesce("first", F.concat(F.lit("0."), F.col("channel").cast("string"))), F.array_join(numbers, " ")))


def literals() -> Column:
    return F.transform(F.arrays_zip("re", "im"), lambda z: F.concat(F.lit("("), z["re"].cast("string"), F.when(z["im"] >= 0, "+").otherwise(""), z["im"].cast("string"), F.lit("j)")))


def described(rows: DataFrame, meta: DataFrame | None) -> DataFrame:
    if meta is None:
        return rows.withColumn("meta", F.lit(None).cast("string")).withColumn("first", F.lit(None).cast("string"))
    own = meta.select("acc", "channel", F.col("station").alias("st0"), F.col("pol").alias("pol0"), "meta", "first")
    return rows.join(own, ["acc", "channel", "st0", "pol0"], "left")


def text_lines(vis: DataFrame, channels: int, meta: DataFrame | None = None) -> DataFrame:
    """Visibilities as text: a key with stations, accumulation and channel, a tab, the first stream's metadata, and the coefficients."""
    return described(vis, meta).select(line("px", channels, literals()).alias("value"))


def tone_lines(tones: DataFrame, channels: int, meta: DataFrame | None = None) -> DataFrame:
    """Calibration tones (acc, channel, sp, k, re, im, n_windows) as text lines of the same form, of each stream with itself."""
    rows = spectra_rows(tones.withColumn("sp0", F.col("sp")).withColumn("sp1", F.col("sp")))
    return described(rows, meta).select(line("pcal", channels, literals()).alias("value"))


def read_text_lines(lines: DataFrame, kind: str = "px") -> DataFrame:
    """The inverse of text_lines(), or of tone_lines() with kind pcal; lines of other kinds are left out."""
    key = rf"^{kind}-(\d+)\.(\d+)-(\d+)\.(\d+)-a\.(\d+)\.(\d+)\.(\d+)-sxa(\d+)\t"
    part = lambda i: F.regexp_extract("value", key, i)
    numbers = F.filter(F.split(F.regexp_replace("value", "^[^\t]*\t", ""), " "), lambda x: F.startswith(x, F.lit("(")))
    pattern = r"\((-?[0-9.]+(?:E-?[0-9]+)?)([+-][0-9.]+(?:E-?[0-9]+)?)j\)"
    take = lambda i: F.transform(numbers, lambda x: F.regexp_extract(x, pattern, i).cast("double"))
    names = {"st0": 1, "pol0": 2, "st1": 3, "pol1": 4, "acc": 6, "channel": 7}
    return lines.where(F.col("value").rlike(key)).select(*(part(i).cast("int").alias(n) for n, i in names.items()), part(8).cast("long").alias("n_windows"), take(1).alias("re"), take(2).alias("im"))


def printed(spec: str, number: Column) -> Column:
    """A number by C's format, null if it is null: rounded from the double itself, where Java's rounds its shortest decimals, and ties to even."""

    @F.arrow_udf("string")
    def work(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else spec % v for v in x.to_pylist()], pa.string())

    return work(number.cast("double"))


def listed(rows: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """The rows whose column begins with a prefix."""
    return rows.where(F.startswith(F.col(column), F.lit(prefix)))


def tone_records(tones: DataFrame, bands: DataFrame, *, pols: str = "XY", conjugate: bool = False, scale: float = 0) -> DataFrame:
    """acc, sp, channel, nr and text of each record of a calibration file: frequency in MHz, polarisation, re and im.

    tones: acc, channel, sp, k, re, im; bands: channel, f (of the upper edge), bw, f_pcal, n (coefficients), a dimension.  The
    tones of a band go down from its highest one; one that is outside the band is an invalid record.
    """
    places = bands.select("channel", "f", "f_pcal", F.posexplode(post.tone_positions(F.col("f") - F.col("bw"), F.col("f_pcal"), F.col("bw"), F.col("n"))).alias("nr", "k"))
    step = F.floor(F.col("f_pcal") / 1e6).cast("long")
    freq = F.floor(F.floor(F.col("f") / 1e6) / step).cast("long") * step - F.col("nr") * step
    own = tones.select("acc", "sp", "channel").distinct().join(dimension(places), "channel").join(tones.select("acc", "sp", "channel", "k", "re", "im"), ["acc", "sp", "channel", "k"], "left")
    number = lambda x: F.concat(F.when(x > 0, " ").otherwise(""), printed("%.5e", x))
    factor = scale or 1.0
    pol = F.element_at(F.array(*map(F.lit, pols)), (F.col("sp") % 2 + 1).cast("int"))
    text = F.concat_ws(" ", freq.cast("string"), pol, number(F.col("re") * factor), number(F.col("im") * (-factor if conjugate else factor)))
    return own.select("acc", "sp", "channel", "nr", F.when(F.col("re").isNull() | F.col("im").isNull(), INVALID_TONE).otherwise(text).alias("text"))


def calibration_lines(records: DataFrame, stations: DataFrame, *, mjd: int, start: float, period: float, n_bands: int, n_tones: int) -> DataFrame:
    """station, name, acc and the line of each accumulation period of a station: its name, the middle of the period, duration,
    stream, bands, tones, and all records in the order of channels, polarisations and tones.  A station without tones has none."""
    entry = F.struct("channel", (F.col("sp") % 2).alias("pol"), "nr", "text")
    rows = records.groupBy(F.floor(F.col("sp") / 2).cast("int").alias("station"), "acc").agg(F.array_sort(F.collect_list(entry)).alias("all")).join(dimension(stations.select("station", "name")), "station")
    day = F.lit(mjd) + (start + (F.col("acc") + 0.5) * period) / 86400
    head = F.format_string(f"%s %s {period / 86400:.7f} %d {n_bands} {n_tones}", "name", printed("%.7f", day), "station")
    return rows.select("station", "name", "acc", F.concat_ws(" ", head, F.array_join(F.transform("all", lambda x: x["text"]), " ")).alias("value"))


def write_calibration(lines: DataFrame, path: str, *, mjd: int, start: float) -> None:
    """Writes the lines of each station, after the header, into a file of the folder `path`; one task a station."""
    head = F.explode(F.array(*(F.struct(F.lit(i - len(CALIBRATION_HEADER)).alias("acc"), F.lit(h).alias("value")) for i, h in enumerate(CALIBRATION_HEADER))))
    filled = F.replace(F.replace(F.replace(F.col("h.value"), F.lit("{mjd}"), F.lit(str(mjd))), F.lit("{start}"), F.lit(str(int(start)))), F.lit("{station}"), F.col("name"))
    heads = lines.select("name").distinct().select("name", head.alias("h")).select("name", F.col("h.acc").alias("acc"), filled.alias("value"))
    rows = heads.unionByName(lines.select("name", "acc", "value")).repartition("name").sortWithinPartitions("name", "acc")
    file = F.concat(F.lit(calibration_name(mjd, start, "")), F.col("name"))
    write_files(rows.select(file.alias("file"), F.concat("value", F.lit("\n")).cast("binary").alias("body")), path)


def export(vis: DataFrame, tones: DataFrame | None, bands: DataFrame, stations: DataFrame, path: str, *, mjd: int, start: float, period: float, n_bands: int, n_tones: int, **options) -> None:
    """Binary records and, if there are tones, calibration files of one scan, in one folder."""
    write_swin(spectra_rows(vis), f"{path}/{swin_name(mjd, start)}", mjd=mjd, start=start, period=period, **options)
    if tones is not None:
        lines = calibration_lines(tone_records(tones, bands), stations, mjd=mjd, start=start, period=period, n_bands=n_bands, n_tones=n_tones)
        write_calibration(lines, path, mjd=mjd, start=start)
