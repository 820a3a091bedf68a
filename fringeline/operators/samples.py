"""Sample kernels on DataFrames: a row holds one window of a stream as an array, and batches are worked on as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeline.operators import kernels
from fringeline.sources import vdif

DOUBLES = T.ArrayType(T.DoubleType())


def with_range(rows: DataFrame, value: str) -> DataFrame:
    """rows with the least and greatest value of all, low and high."""
    return rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))))  # one row


def quantised(value: Column, low: Column, high: Column, bits: int) -> Column:
    """Number of the nearest of 2 ** bits even levels from low to high; half-way values go down."""
    n = (1 << bits) - 1
    return sum(((value > low + (high - low) * (2 * k + 1) / (2 * n)).cast("int") for k in range(n)), F.lit(0))


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each list; lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(m: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list for each row; rows of rows are lists of lists."""
    flat = pa.array(np.ascontiguousarray(m).reshape(-1), kind or pa.float64())
    for axis in range(m.ndim - 1, 0, -1):
        count = int(np.prod(m.shape[:axis]))
        flat = pa.ListArray.from_arrays(pa.array((np.arange(count + 1) * m.shape[axis]).astype(np.int32)), flat)
    return flat


def mapped(rows: DataFrame, new: dict[str, T.DataType], work: Callable[[dict[str, np.ndarray]], dict[str, pa.Array]], columns: tuple[str, ...] = ("samples",)) -> DataFrame:
    """rows with new columns, worked out from these columns of a batch; array columns come as matrices."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in new), *(T.StructField(n, t) for n, t in new.items())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values = {c: matrix(b.column(c)) if pa.types.is_list(b.column(c).type) else b.column(c).to_numpy(zero_copy_only=False) for c in columns}
            made = work(values)
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in new else b.column(f.name) for f in schema.fields], names=schema.names)

    return rows.mapInArrow(each, schema)


def dequantised(rows: DataFrame, bits: int, *, q: str = "q", out: str = "x", even: bool = False) -> DataFrame:
    """rows with the value of each stored component."""
    return mapped(rows, {out: T.DoubleType()}, lambda c: {out: pa.array(kernels.levels(c[q].astype(np.int64), bits, even=even))}, (q,))


def paired(rows: DataFrame) -> DataFrame:
    """rows with re and im of the complex samples of interleaved components."""

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        z = kernels.pairs(c["samples"])
        return {"re": lists(z.real), "im": lists(z.imag)}

    return mapped(rows, {"re": DOUBLES, "im": DOUBLES}, work)


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binary values."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def packed(rows: DataFrame, bits: int, *, q: str = "q", out: str = "packed") -> DataFrame:
    """rows with the 32-bit words, as binary, that hold an array of components; a batch is packed as one array."""

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        per = 32 // bits
        n, count = c[q].shape
        whole = np.zeros((n, -(-count // per) * per), np.uint32)
        whole[:, :count] = c[q]
        return {out: binaries(np.frombuffer(vdif.pack(whole.ravel(), bits), np.uint8).reshape(n, -1))}

    return mapped(rows, {out: T.BinaryType()}, work, (q,))


def unpacked(rows: DataFrame, bits: int, *, payload: str = "payload", out: str = "q") -> DataFrame:
    """rows with the components, array<int>, of binary payloads of 32-bit words; a batch is unpacked as one array."""

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        bodies = [bytes(x) for x in c[payload]]
        size = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4 * 4
        flat = vdif.unpack(b"".join(x[:n] for x, n in zip(bodies, size.tolist(), strict=True)), bits).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(size * 8 // bits)]).astype(np.int32)
        return {out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

    return mapped(rows, {out: T.ArrayType(T.IntegerType())}, work, (payload,))


def little_endian(rows: DataFrame, word: str, *, out: str = "payload") -> DataFrame:
    """rows with the four bytes of a 32-bit word, the lowest first."""
    return mapped(rows, {out: T.BinaryType()}, lambda c: {out: binaries(c[word].astype("<u4").view(np.uint8).reshape(-1, 4))}, (word,))


def turned(rows: DataFrame, channels: int, is_complex: bool) -> DataFrame:
    """rows with `turned`, the samples of each channel, of components that are interleaved by channel."""
    return mapped(rows, {"turned": T.ArrayType(DOUBLES)}, lambda c: {"turned": lists(vdif.corner_turn(c["samples"], channels, is_complex))})


def statistics(rows: DataFrame) -> DataFrame:
    """rows with the number, the least, the greatest and the mean of each window's samples."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("n", F.size("samples").cast("long")).withColumn("low", F.array_min("samples")).withColumn("high", F.array_max("samples")).withColumn("mean", total / F.size("samples"))


def rotated(rows: DataFrame, *, mode: str = "full") -> DataFrame:
    """rows with re and im of the fringe-rotated samples (see kernels.fringe_rotate).

    rows: samples, w (number of the window), fs, freq, lower_complex, d0, d1, d2.
    """

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        n = c["samples"].shape[1]
        each = lambda k: c[k].astype(float)[:, None]
        z = kernels.fringe_rotate(c["samples"], each("w") * n, each("fs"), each("freq"), [each(d) for d in ("d0", "d1", "d2")], lower_complex=c["lower_complex"].astype(bool)[:, None], mode=mode)
        return {"re": lists(z.real), "im": lists(z.imag)}

    return mapped(rows, {"re": DOUBLES, "im": DOUBLES}, work, ("samples", "w", "fs", "freq", "lower_complex", "d0", "d1", "d2"))


def fraction_rotated(rows: DataFrame, kind: str) -> DataFrame:
    """rows with re and im of the spectra of the samples, turned by the fraction of a sample of each window's delay.

    kind: complex (the whole band), upper or lower (that half of a real signal's).  rows: samples, w, fs, d0, d1, d2.
    """

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        n = c["samples"].shape[1]
        f = np.fft.fft(c["samples"], axis=1)
        if kind != "complex":
            f = kernels.half_band(f, "L" if kind == "lower" else "U")
        d = kernels.delay([c["d0"], c["d1"], c["d2"]], c["w"] * n / c["fs"])
        z = kernels.fraction_rotate(f, kernels.fraction(d, c["fs"]), kind, n)
        return {"re": lists(z.real), "im": lists(z.imag)}

    return mapped(rows, {"re": DOUBLES, "im": DOUBLES}, work, ("samples", "w", "fs", "d0", "d1", "d2"))


def slips(rows: DataFrame, n: int) -> DataFrame:
    """rows with kind (1 drop, -1 insert, 0) and slip_at, of windows of n samples (d_start, d_end, slope, fs)."""

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        kind, at = kernels.slips(c["d_start"], c["d_end"], c["slope"], c["fs"], n)
        return {"kind": pa.array(kind, pa.int32()), "slip_at": pa.array(at, pa.int32(), mask=kind == 0)}

    return mapped(rows, {"kind": T.IntegerType(), "slip_at": T.IntegerType()}, work, ("d_start", "d_end", "slope", "fs"))


def slipped(rows: DataFrame) -> DataFrame:
    """rows whose samples have dropped or got one (kind) at slip_at."""

    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        x, kind, at = c["samples"], c["kind"].astype(np.int64), np.nan_to_num(c["slip_at"].astype(float)).astype(np.int64)
        n, size = x.shape
        wide = np.zeros((n, size + 1))
        place = np.arange(size) + ((kind < 0)[:, None] & (np.arange(size) >= at[:, None]))
        np.put_along_axis(wide, place, x, 1)  # an inserted sample is 0
        keep = np.arange(size + 1) < (size - np.minimum(kind, 0))[:, None]
        keep[(kind > 0)[:, None] & (np.arange(size + 1) == at[:, None])] = False
        offsets = np.concatenate([[0], np.cumsum(size - kind)]).astype(np.int32)
        return {"samples": pa.ListArray.from_arrays(pa.array(offsets), pa.array(wide[keep]))}

    return mapped(rows, {"samples": DOUBLES}, work, ("samples", "kind", "slip_at"))


def headers(rows: DataFrame, words: tuple[str, str, str, str]) -> DataFrame:
    """rows with the fields of frame headers given as four words."""
    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        return {n: pa.array(v) for n, v in vdif.decode_headers(np.stack([c[w] for w in words], 1)).items()}

    return mapped(rows, {n: T.LongType() for n in vdif.FIELDS}, work, words)


def header_words(rows: DataFrame) -> DataFrame:
    """rows with the four words w0 to w3 of their header fields."""
    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        out = vdif.encode_headers(c)
        return {f"w{i}": pa.array(out[:, i].astype(np.int64)) for i in range(4)}

    return mapped(rows, {f"w{i}": T.LongType() for i in range(4)}, work, tuple(vdif.FIELDS))
