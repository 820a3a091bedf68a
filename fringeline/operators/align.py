"""Frames to delay-aligned chunks of samples, one row for each frame and channel.

A frame's time picks the block whose delay applies; the whole samples of that delay shift the frame, and the
block of its last aligned sample takes it.  Samples before that block's start are skipped.  Sample numbers count
from the block's start, so later stages never depend on the order or completeness of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeline.operators import kernels
from fringeline.operators.delays import shift_and_fraction
from fringeline.operators.joins import dimension
from fringeline.sources.vdif import corner_turn, unpack

CHUNKS = (
    "acc_block int, source_id int, channel int, station int, pol int, first_sample long, n_samples int, skip int, bits int, is_complex boolean, fs double, freq_hz double, sideband string, "
    "shift long, frac double, d0 double, d1 double, d2 double, f_pcal double, samples binary"
)
MIDDLE = "acc_block int, source_id int, station int, idx int, first_sample long, n_samples int, skip int, bits int, is_complex boolean, fs double, shift long, frac double, d0 double, d1 double, d2 double, samples binary"
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Payload bytes that are unpacked together.
BYTES = 2 << 20


def block_of(t: Column, start: float, period: float, blocks: int) -> Column:
    """Tumbling window of a time; null before the start and after the end."""
    k = F.floor((t - start) / period)
    return F.when((t >= start) & (k < blocks), k).cast("int")


def place_in_block(t: Column, start: float, period: float, fs: float | Column) -> Column:
    """Number of the sample that is nearest to a time, from its block's start on."""
    return F.floor((t - start - F.floor((t - start) / period) * period) * fs + 0.5)


def selected(frames: DataFrame, *, start: float | None = None, end: float | None = None, first: int = -1, count: int = -1, number: str = "frame_num") -> DataFrame:
    """Frames of the times [start, end) and, unless either is negative, of the frame numbers [first, first + count) of each second."""
    out = frames
    if start is not None:
        out = out.where(F.col("t") >= start)
    if end is not None:
        out = out.where(F.col("t") < end)
    return out.where(in_numbers(F.col(number), first, count)) if first >= 0 and count >= 0 else out


def in_numbers(number: Column, first: int, count: int) -> Column:
    return (number >= first) & (number < first + count)


def nearest_epoch(rows: DataFrame, t: str, epochs: list[float], out: str = "epoch") -> DataFrame:
    """rows with the number of the epoch nearest to t, the first of equally near ones; epochs rise, and are few (a dimension)."""
    at = np.array(epochs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(t).to_numpy(zero_copy_only=False)
            high = np.clip(np.searchsorted(at, x), 1, len(at) - 1) if len(at) > 1 else np.zeros(len(x), np.int64)
            low = np.maximum(high - 1, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(np.abs(x - at[low]) <= np.abs(x - at[high]), low, high), pa.int32())], names=[*b.schema.names, out])

    return rows.mapInArrow(work, rows.withColumn(out, F.lit(0)).schema)


def aligned(frames: DataFrame, polys: DataFrame, *, start: float, period: float, blocks: int, drop_invalid: bool = False) -> DataFrame:
    """Frames with their block, the first sample there, the samples to skip, and the block's delay, for each source.

    frames: station, t, fs, bits, is_complex, log2_channels, payload, complete; polys: block, source_id, station, rel, d0,
    d1, d2.  Truncated frames, frames outside the scan and frames without a delay are left out; so are invalid ones on demand.
    Short scans' polynomials are broadcast by the optimiser; those of many blocks are joined as their size asks for.
    """
    good = frames.where("complete")
    if drop_invalid:
        good = good.where("NOT invalid")
    per = F.when(F.col("is_complex"), 2).otherwise(1)
    spf = F.floor(F.octet_length("payload") * 8 / F.col("bits") / F.pow(F.lit(2), F.col("log2_channels")) / per)
    rows = good.withColumn("spf", spf.cast("long")).withColumn("guess", block_of(F.col("t"), start, period, blocks)).where("guess IS NOT NULL")
    model = polys.select("station", "source_id", F.col("block").alias("guess"), "rel", "d0", "d1", "d2")
    one = rows.join(model.select("station", "source_id", "guess", "rel"), ["station", "guess"])
    per_block = F.round(F.lit(period) * F.col("fs")).cast("long")
    absolute = F.round((F.col("t") - start) * F.col("fs")).cast("long")
    whole, _ = shift_and_fraction(F.col("rel"), F.col("fs"), F.lit(False))
    one = one.withColumn("block", F.floor((absolute - whole + F.col("spf") - 1) / per_block).cast("int")).drop("rel", "guess")
    two = one.where((F.col("block") >= 0) & (F.col("block") < blocks)).join(model.withColumnRenamed("guess", "block"), ["station", "source_id", "block"])
    shift, frac = shift_and_fraction(F.col("rel"), F.col("fs"), F.lit(False))
    first = absolute - F.col("shift") - F.col("block") * per_block
    return two.withColumn("shift", shift).withColumn("frac", frac).withColumn("first", first).withColumn("cut", F.greatest(F.lit(0), -F.col("first"))).where("cut < spf")


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binary values."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def turned(b: pa.RecordBatch) -> pa.RecordBatch:
    """MIDDLE of frames of one layout: all unpacked and turned as one array, and stored again by channel."""
    of = lambda c: b.column(c).to_numpy(zero_copy_only=False)
    n, bits, is_complex, channels, spf = b.num_rows, of("bits")[0].item(), bool(of("is_complex")[0]), 1 << of("log2_channels")[0].item(), of("spf")[0].item()
    payload = pa.concat_arrays([b.column("payload")])
    start = np.frombuffer(payload.buffers()[1], np.int32, n + 1, payload.offset * 4)
    raw = np.frombuffer(payload.buffers()[2], np.uint8, int(start[-1] - start[0]), int(start[0]))
    raw = raw.reshape(n, -1)[:, : len(raw) // n // 4 * 4]
    parts = corner_turn(unpack(raw.tobytes(), bits).reshape(n, -1)[:, : spf * channels * (2 if is_complex else 1)], channels, is_complex)
    samples = kernels.stored(parts, bits).reshape(n * channels, -1)
    many = lambda c: np.repeat(of(c), channels)
    columns = {"acc_block": many("block"), "idx": np.tile(np.arange(channels), n) if channels > 1 else of("thread_id"), "first_sample": many("first") + many("cut"), "n_samples": spf - many("cut"), "skip": many("cut"), "samples": binaries(samples)}
    fields = [c.split() for c in MIDDLE.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c == "samples" else pa.array(columns[c] if c in columns else many(c), ARROW[kind]) for c, kind in fields], names=[c for c, _ in fields])


def chunks(frames: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each aligned frame and channel: unpacked, turned, stored anew; media gives the meaning of each index.

    media: station, idx, channel, pol, freq_hz, sideband, f_pcal.  A frame of one channel uses its thread as index.  The
    first `skip` of a row's samples are not part of its block.
    """
    columns = [c.rsplit(" ", 1)[0] for c in CHUNKS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layout = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bits", "is_complex", "log2_channels", "spf")] + [np.diff(np.frombuffer(b.column("payload").buffers()[1], np.int32, b.num_rows + 1, b.column("payload").offset * 4))])
            for kind in np.unique(layout, axis=1).T:
                rows = np.flatnonzero((layout == kind[:, None]).all(0))
                step = max(1, BYTES // max(1, int(kind[-1])))
                for i in range(0, len(rows), step):
                    yield turned(b.take(pa.array(rows[i : i + step])))

    use = ["station", "block", "source_id", "thread_id", "bits", "is_complex", "log2_channels", "spf", "first", "cut", "fs", "shift", "frac", "d0", "d1", "d2", "payload"]
    described = dimension(media.select("station", "idx", "channel", "pol", "freq_hz", "sideband", "f_pcal"))
    return frames.select(*use).mapInArrow(work, MIDDLE).join(described, ["station", "idx"]).select(columns)
