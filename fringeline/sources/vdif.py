"""VDIF frames: a codec on NumPy arrays, and a Spark data source that reads files by frame-aligned ranges.

A frame is 32 bytes of header in little-endian 32-bit words, then packed samples, the first one in the least
significant bits of each word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: The setting by which Spark offers conditions to data sources of Python.
PUSH = "spark.sql.python.filterPushdown.enabled"
HEADER = 32
SCHEMA = (
    "file string, offset long, invalid boolean, legacy boolean, seconds long, epoch int, frame_num int, version int, log2_channels int, "
    "frame_bytes long, is_complex boolean, bits int, thread_id int, station_code int, complete boolean, payload binary"
)
#: word, lowest bit and number of bits of each header field.
FIELDS = {
    "invalid": (0, 31, 1), "legacy": (0, 30, 1), "seconds": (0, 0, 30), "epoch": (1, 24, 6), "frame_num": (1, 0, 24), "version": (2, 29, 3),
    "log2_channels": (2, 24, 5), "frame_words": (2, 0, 24), "is_complex": (3, 31, 1), "bits_less_one": (3, 26, 5), "thread_id": (3, 16, 10), "station_code": (3, 0, 16),
}


def decode_headers(words: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of headers given as rows of four words or more; frame_words counts 8 bytes each, header included."""
    words = words.astype(np.int64)
    return {name: words[:, w] >> low & (1 << n) - 1 for name, (w, low, n) in FIELDS.items()}


def decode_header(raw: bytes) -> dict[str, int]:
    return {name: int(v[0]) for name, v in decode_headers(np.frombuffer(raw, "<u4", 4)[None, :]).items()}


def encode_headers(fields: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of the eight words of headers; fields that are not given are 0."""
    out = np.zeros((len(next(iter(fields.values()))), HEADER // 4), np.int64)
    for name, values in fields.items():
        w, low, n = FIELDS[name]
        values = np.asarray(values, np.int64)
        if ((values < 0) | (values >= 1 << n)).any():
            raise ValueError(f"{name} does not fit {n} bits")
        out[:, w] |= values << low
    return out.astype("<u4")


def encode_header(**fields: int) -> bytes:
    return encode_headers({k: np.array([v]) for k, v in fields.items()}).tobytes()


def unpack(payload: bytes, bits: int, *, msb_first: bool = False) -> np.ndarray:
    """Sample components of a payload: of 32-bit words from the least significant bits up, or of bytes from the most significant ones down."""
    if msb_first:
        if 8 % bits:
            raise ValueError("bits must divide 8")
        return (np.frombuffer(payload, np.uint8)[:, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & np.uint8((1 << bits) - 1)).ravel().astype(np.uint32)
    if 32 % bits:
        raise ValueError("bits must divide 32")
    words = np.frombuffer(payload[: len(payload) // 4 * 4], "<u4")
    shifts = np.arange(0, 32, bits, dtype=np.uint32)
    mask = np.uint32((1 << bits) - 1 if bits < 32 else 0xFFFFFFFF)
    return (words[:, None] >> shifts & mask).ravel()


def pack(samples: np.ndarray, bits: int, *, msb_first: bool = False) -> bytes:
    """The inverse of unpack(); the last word (or byte) is filled with zeros."""
    unit, kind = (8, np.uint8) if msb_first else (32, np.uint32)
    per = unit // bits
    padded = np.zeros(-(-len(samples) // per) * per, kind)
    padded[: len(samples)] = samples
    shifts = np.arange(0, unit, bits, dtype=kind)
    return np.bitwise_or.reduce(padded.reshape(-1, per) << (shifts[::-1] if msb_first else shifts), axis=1).astype("u1" if msb_first else "<u4").tobytes()


def corner_turn(components: np.ndarray, channels: int, is_complex: bool) -> np.ndarray:
    """A row for each channel, of one payload or of each row of several; complex components stay interleaved as I, Q."""
    lead = components.shape[:-1]
    if is_complex:
        return np.moveaxis(components.reshape(*lead, -1, channels, 2), -2, -3).reshape(*lead, channels, -1)
    return components.reshape(*lead, -1, channels).swapaxes(-1, -2)


def frame(samples: np.ndarray, *, bits: int, channels: int = 1, is_complex: bool = False, **fields: int) -> bytes:
    """A frame of components that are interleaved by channel."""
    body = pack(samples, bits)
    body += b"\0" * (-len(body) % 8)
    head = encode_header(frame_words=(len(body) + HEADER) // 8, log2_channels=channels.bit_length() - 1, is_complex=int(is_complex), bits_less_one=bits - 1, **fields)
    return head + body


class FrameRange(InputPartition):
    def __init__(self, path: str, first: int, end: int, length: int):
        super().__init__((path, first, end))
        self.path, self.first, self.end, self.length = path, first, end, length


def epoch_mjd(epoch: int) -> int:
    """Modified Julian day on which a half-year begins, counted from 2000 on."""
    import datetime

    return (datetime.date(2000 + epoch // 2, 1 + 6 * (epoch % 2), 1) - datetime.date(2000, 1, 1)).days + 51544


class VdifReader(DataSourceReader):
    """Frames of files whose frames have the length of their first one, read in blocks and decoded together.

    Options: path (comma-separated files that all executors see), frames_per_partition, payload (false reads headers
    only), t_start and t_end (seconds since the epoch of the headers; frames outside are left out), skip_bytes, and
    scan_start and scan_end (mjd:seconds, the same bounds for files of any epoch).  ordered (true: seconds never fall within
    a file, but for `slack` frames) bounds each file by a binary search of its headers, so that ranges outside are never opened.
    A header that gives another length (of a damaged or zero-filled file), and a frame or header cut off by the file's end, is a
    row with complete false; the next frame is looked for one length on.
    """

    #: Bytes read at once.
    BLOCK = 4 << 20

    def __init__(self, options: dict[str, str]):
        self.paths = [p.removeprefix("file:") for p in options["path"].split(",")]
        self.per = int(options.get("frames_per_partition", 10_000))
        self.payload = options.get("payload", "true").lower() != "false"
        self.low, self.high = int(options.get("t_start", 0)), int(options.get("t_end", 1 << 30))
        self.skip = int(options.get("skip_bytes", 0))
        self.ordered, self.slack = options.get("ordered", "false").lower() == "true", int(options.get("slack", 1000))
        self.scan = [tuple(map(float, options[c].split(":"))) if c in options else None for c in ("scan_start", "scan_end")]
        self.stations: set[int] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        import os

        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                head = self.header(f, self.skip)
                if head is None:
                    continue
                length = head["frame_words"] * 8
                if length < HEADER:
                    raise ValueError(f"{path}: frame length {length}")
                first, end = self.skip, size
                if self.ordered:
                    frames, bounds = (size - self.skip) // length, self.bounds(head["epoch"])
                    low, high = (self.place(f, length, frames, t) for t in bounds)
                    first += max(0, low - self.slack) * length
                    end = size if high + self.slack >= frames else self.skip + (high + self.slack) * length
            step = length * self.per
            out += [FrameRange(path, at, min(at + step, end), length) for at in range(first, end, step)]
        return out

    @staticmethod
    def header(f, at: int) -> dict[str, int] | None:
        f.seek(at)
        raw = f.read(HEADER)
        return decode_header(raw) if len(raw) == HEADER else None

    def bounds(self, epoch: int) -> tuple[int, int]:
        """Seconds of a file's epoch from which on, and before which, its frames are wanted."""
        import math

        own = [None if x is None else (x[0] - epoch_mjd(epoch)) * 86400 + x[1] for x in self.scan]
        return max(self.low, 0 if own[0] is None else math.floor(own[0])), min(self.high, 1 << 30 if own[1] is None else math.ceil(own[1]))

    def place(self, f, length: int, frames: int, t: int) -> int:
        """The first frame whose second is t or later, by headers of the file; damaged ones are stepped over."""
        low, high = 0, frames
        while low < high:
            middle = at = (low + high) // 2
            head = self.header(f, self.skip + at * length)
            while head["frame_words"] * 8 != length and at + 1 < high:
                at += 1
                head = self.header(f, self.skip + at * length)
            if head["frame_words"] * 8 == length and head["seconds"] < t:
                low = at + 1
            else:
                high = middle
        return low

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        block = max(1, self.BLOCK // part.length) * part.length
        with open(part.path, "rb") as f:
            for at in range(part.first, part.end, block):
                f.seek(at)
                raw = f.read(min(block, part.end - at))
                whole = len(raw) // part.length
                if whole:
                    yield self.frames(part, np.frombuffer(raw, np.uint8, whole * part.length).reshape(whole, -1), at)
                rest = raw[whole * part.length :]
                if rest:
                    yield self.frames(part, np.frombuffer(rest.ljust(HEADER, b"\0"), np.uint8)[None, :], at + whole * part.length)

    def frames(self, part: FrameRange, rows: np.ndarray, at: int, files: list[str] | None = None, offsets: np.ndarray | None = None) -> pa.RecordBatch:
        """SCHEMA of rows of bytes that lie end to end from `at` on, or at offsets of files."""
        h = decode_headers(np.ascontiguousarray(rows[:, :16]).view("<u4"))
        low, high = np.array([self.bounds(int(e)) for e in np.unique(h["epoch"])]).reshape(-1, 2)[np.unique(h["epoch"], return_inverse=True)[1]].T
        use = (h["seconds"] >= low) & (h["seconds"] < high)
        if self.stations is not None:
            use &= np.isin(h["station_code"], list(self.stations))
        some = np.flatnonzero(use)
        h = {k: v[some] for k, v in h.items()}
        n, size = len(some), rows.shape[1] - HEADER if self.payload else 0
        body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows[some, HEADER : HEADER + size]))])
        complete = (h["frame_words"] * 8 == part.length) & (rows.shape[1] == part.length)
        columns = {"invalid": h["invalid"] > 0, "legacy": h["legacy"] > 0, "frame_bytes": h["frame_words"] * 8, "is_complex": h["is_complex"] > 0, "bits": h["bits_less_one"] + 1, "complete": complete, "payload": body, "file": [part.path] * n if files is None else [files[i] for i in some.tolist()], "offset": at + some * part.length if offsets is None else offsets[some]}
        fields = ARROW
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name] if f.name in columns else h[f.name], f.type) if f.name != "payload" else body for f in fields], schema=fields)


class FilteringReader(VdifReader):
    """Also applies Spark's conditions on seconds and station_code to the headers; the session's setting PUSH must be on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("seconds",) and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif column == ("seconds",) and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            elif column == ("station_code",) and isinstance(f, EqualTo | In):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.stations = own if self.stations is None else self.stations & own
            else:
                yield f


#: SCHEMA as Arrow's.
ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


class VdifStreamReader(DataSourceStreamReader):
    """Frames of files that grow, or come, while a stream reads them: options as of VdifReader, path is a folder that all see.

    An offset holds the bytes of each file that are read, from skip_bytes on; only whole frames are admitted, so a frame
    that is being written is read once it is there.  Names that begin with a dot or an underscore are no recordings.
    """

    def __init__(self, options: dict[str, str]):
        self.files = VdifReader(options)
        self.folder = self.files.paths[0]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        import os

        out = {}
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if name[0] in "._" or not os.path.isfile(path):
                continue
            if length := self.length(path):
                out[path] = self.files.skip + (os.path.getsize(path) - self.files.skip) // length * length
        return out

    def length(self, path: str) -> int:
        """Bytes of a file's frames; 0 before its first header is there."""
        with open(path, "rb") as f:
            head = self.files.header(f, self.files.skip)
        if head is None:
            return 0
        if head["frame_words"] * 8 < HEADER:
            raise ValueError(f"{path}: frame length {head['frame_words'] * 8}")
        return head["frame_words"] * 8

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, last in end.items():
            length = self.length(path)
            step = length * self.files.per
            out += [FrameRange(path, at, min(at + step, last), length) for at in range(start.get(path, self.files.skip), last, step)]
        return out

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        return self.files.read(part)


class VdifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vdif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VdifReader:
        return (FilteringReader if self.options.get("push") == "true" else VdifReader)(self.options)

    def streamReader(self, schema) -> VdifStreamReader:
        return VdifStreamReader(self.options)


def read_frames(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(VdifSource)
    return spark.read.format("vdif").options(path=",".join(paths), push=spark.conf.get(PUSH, "false"), **options).load()


def stream_frames(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Frames of a folder's files as a stream; what is appended to a file, or comes as a new one, is read by the next micro-batch."""
    spark.dataSource.register(VdifSource)
    return spark.readStream.format("vdif").options(path=folder, **options).load()


def read_records(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """Frames as read_frames() gives them, of files in any store that Spark reads (paths or globs): the JVM splits them into records.

    The files of one frame length are read together, by splits of whole frames; headers are decoded in batches.  A file whose
    last frame is cut off is read as one piece, as records must be whole, so it must be smaller than 2 GB.  skip_bytes is not
    supported.  Options: payload, t_start, t_end, scan_start and scan_end.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    whole: dict[int, list[str]] = {}
    cut: dict[int, list[str]] = {}
    for pattern in paths:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = at.getFileSystem(conf)
        for status in fs.globStatus(at) or ():
            if status.getPath().getName()[0] in "._" or status.getLen() < HEADER:
                continue
            f = fs.open(status.getPath())
            try:
                length = decode_header(bytes(jvm.org.apache.commons.io.IOUtils.readFully(f, HEADER)))["frame_words"] * 8
            finally:
                f.close()
            if length < HEADER:
                raise ValueError(f"{status.getPath()}: frame length {length}")
            (cut if status.getLen() % length else whole).setdefault(length, []).append(status.getPath().toString())
    parts = []
    for length, files in sorted(whole.items()):
        records = spark._jsc.binaryRecords(",".join(files), length).rdd()
        rows = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
        # a split is a partition, and begins at a whole record
        place = F.input_file_block_start() + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) * length
        parts.append(decoded(rows.select(F.col("value").alias("body"), F.input_file_name().alias("file"), place.alias("offset")), length, options))
    for length, files in sorted(cut.items()):
        rows = spark.read.format("binaryFile").load(files).select(F.col("content").alias("body"), F.col("path").alias("file"), F.lit(0).cast("long").alias("offset"))
        parts.append(decoded(rows, length, options))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decoded(rows: DataFrame, length: int, options: dict[str, str]) -> DataFrame:
    """SCHEMA of rows body, file, offset, whose bodies are one frame or several of this length end to end."""
    reader = VdifReader(options | {"path": ""})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = pa.concat_arrays([b.column("body")]).cast(pa.large_binary())
            start = np.frombuffer(body.buffers()[1], np.int64, b.num_rows + 1, body.offset * 8)
            data, files, offset = np.frombuffer(body.buffers()[2], np.uint8) if b.num_rows else np.zeros(0, np.uint8), b.column("file").to_pylist(), b.column("offset").to_numpy()
            many = np.diff(start) != length
            single = np.flatnonzero(~many)
            for lo in range(0, len(single), step := max(1, reader.BLOCK // length)):
                some = single[lo : lo + step]
                yield reader.frames(FrameRange("", 0, 0, length), data[start[some][:, None] + np.arange(length)], 0, [files[i] for i in some.tolist()], offset[some])
            for i in np.flatnonzero(many).tolist():
                for at in range(0, int(start[i + 1] - start[i]), length):
                    raw = data[start[i] + at : min(start[i] + at + length, start[i + 1])].tobytes()
                    yield reader.frames(FrameRange("", 0, 0, length), np.frombuffer(raw.ljust(HEADER, b"\0"), np.uint8)[None, :], 0, [files[i]], offset[i : i + 1] + at)

    return rows.mapInArrow(work, SCHEMA)


def read_folder(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Frames of all files of a folder that the driver sees."""
    import os

    return read_frames(spark, sorted(f"{folder}/{f}" for f in os.listdir(folder) if not f.startswith(".")), **options)


def mjd_of(epoch: Column, seconds: Column) -> Column:
    """Modified Julian day of seconds since a half-year that is counted from 2000 on."""
    day = F.make_date(F.floor(epoch / 2).cast("int") + 2000, F.when(epoch % 2 == 0, 1).otherwise(7), F.lit(1))
    return (F.datediff(day, F.lit("2000-01-01").cast("date")) + 51544 + F.floor(seconds / 86400)).cast("int")


def half_year(date: Column) -> tuple[Column, Column]:
    """Half-years from 2000 to a date (the first of July is of the first half), and seconds from 2000-01-01 to its midnight."""
    late = (F.month(date) > 7) | ((F.month(date) == 7) & (F.dayofmonth(date) > 1))
    return ((F.year(date) - 2000) * 2 + late.cast("int")).cast("int"), F.datediff(date, F.lit("2000-01-01").cast("date")).cast("long") * 86400


def with_time(frames: DataFrame, fs: float | Column, *, mjd_start: int | None = None) -> DataFrame:
    """mjd, sec (of the day) and t of each frame; samples are counted by channel.

    t is sec and the frame's place in it; with mjd_start it goes on from that day's midnight, so that a scan may last
    over the next one.
    """
    parts = F.when(F.col("is_complex"), 2).otherwise(1)
    samples = (F.col("frame_bytes") - HEADER) * 8 / F.col("bits") / F.pow(F.lit(2), F.col("log2_channels")) / parts
    out = frames.withColumn("mjd", mjd_of(F.col("epoch"), F.col("seconds"))).withColumn("sec", F.col("seconds") % 86400)
    days = F.lit(0) if mjd_start is None else F.col("mjd") - mjd_start
    return out.withColumn("t", days * 86400 + F.col("sec") + F.col("frame_num") * samples / fs)


def file_summary(frames: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Profile of each file: frames, bytes, stations, threads, sizes, seconds."""
    return frames.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.sum("frame_bytes").alias("bytes"), F.countDistinct("station_code").alias("stations"), F.countDistinct("thread_id").alias("threads"),
        F.countDistinct("frame_bytes").alias("sizes"), F.countDistinct("bits").alias("bits"), F.countDistinct("seconds").alias("seconds"), (F.max("frame_num") + 1).alias("frames_per_second"),
        F.count_if(~F.col("complete")).alias("truncated"), F.count_if("invalid").alias("invalid"),
    )


def frames_per_second(frames: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Frames of a second, by the greatest frame number."""
    return frames.groupBy(*keys).agg((F.max("frame_num") + 1).alias("frames"))


def runs(rows: DataFrame, number: str, keys: tuple[str, ...]) -> DataFrame:
    """Runs of successive whole numbers by key: first, last and how many; repeated numbers count once."""
    n = F.col(number)
    island = n - F.row_number().over(Window.partitionBy(*keys).orderBy(n))
    return rows.select(*keys, n).distinct().withColumn("island", island).groupBy(*keys, "island").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("n")).drop("island")


def listing(rows: DataFrame, order: tuple[str, ...], *, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in order, from one on, and at most so many."""
    out = rows.orderBy(*order).offset(skip)
    return out if limit is None else out.limit(limit)
