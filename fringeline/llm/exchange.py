"""Questions about keys, asked by buckets of texts and answered by ranges of keys.

Texts are dealt into buckets of a few megabytes by a hash of doc_id and text, so rows of one doc_id or without one are
spread too (only rows that repeat doc_id and text lie together).  A bucket reduces its keys (64-bit hashes) to distinct ones, and sends them packed, one row for each key
range.  There are as many ranges as buckets; buckets grow with the square root of the corpus (6 MB to 90 GB, 20 MB at
1 TB, 200 MB at 100 TB), so a message holds tens of keys however large the corpus is.  The worker of a key range sees
what all buckets say about a key, and sends back one packed answer in the order of the bucket's keys.  So a
key that a third of all rows hold costs one entry a bucket, no key is joined with rows, the text crosses the
network once (the later stages reuse that exchange), and what a task holds is a bucket or a key range, whose
sizes are set here and not by the data's skew.  All of it is a function of the input, so lost tasks can be run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 6 << 20
#: Keys that a message has at least, and bytes of text that a key stands for, about.
MESSAGE, KEY_BYTES = 64, 6
ASK = "p int, t int, n long, body binary"
REPLY = "t int, kind int, p int, body binary"


def bucket_count(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for these texts, from one scan of their sizes."""
    total = texts.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-total // max(bucket_bytes, math.isqrt(MESSAGE * KEY_BYTES * total))))


def in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and the bucket t of each row; other columns go."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(7))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(key, F.lit(buckets)).cast("int").alias("t"))


def ranges_in(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Key ranges of sorted keys, and where the keys of each start and end; work and memory follow the keys, not the ranges."""
    p = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.flatnonzero(group_starts(p))
    return p[cut].astype(np.int64), np.append(cut, len(keys))


def squeeze(values: np.ndarray) -> bytes:
    """Integers in as many bytes each as nearly all of them need; the few larger ones follow whole."""
    values = values.astype(np.uint64)
    n = len(values)
    width = max(1, -(-int(np.partition(values, n - 1 - n // 256)[n - 1 - n // 256]).bit_length() // 8)) if n else 1
    mark = np.uint64(2 ** (8 * width) - 1)
    small = np.minimum(values, mark).astype("<u8")
    large = values[values >= mark].astype("<u8") if width < 8 else values[:0]
    return bytes([width]) + small.view(np.uint8).reshape(n, 8)[:, :width].tobytes() + large.tobytes()


def unsqueeze(raw: bytes | pa.Buffer, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The n integers that start at a byte, and the byte after them."""
    data = np.frombuffer(raw, np.uint8)
    width = int(data[at])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data[at + 1 : at + 1 + n * width].reshape(n, width)
    values = out.view("<u8").ravel().astype(np.uint64)
    at += 1 + n * width
    if width < 8:
        large = np.flatnonzero(values == np.uint64(2 ** (8 * width) - 1))
        values[large] = np.frombuffer(data[at : at + 8 * len(large)].tobytes(), "<u8")
        at += 8 * len(large)
    return values, at


def pack(t: int, keys: np.ndarray, parts: list[np.ndarray], ranges: int, *, tight: bool = False) -> pa.Table:
    """One row for each key range that has keys; keys are sorted, parts run beside them.  tight: steps of keys and parts squeezed."""
    used, cut = ranges_in(keys, ranges)
    if tight:
        body = [b"".join([squeeze(np.diff(keys[cut[i] : cut[i + 1]], prepend=np.uint64(0))), *(squeeze(x[cut[i] : cut[i + 1]]) for x in parts)]) for i in range(len(used))]
    else:
        body = [b"".join([keys[cut[i] : cut[i + 1]].tobytes(), *(x[cut[i] : cut[i + 1]].tobytes() for x in parts)]) for i in range(len(used))]
    n = len(used)
    return pa.table({"p": pa.array(used, pa.int32()), "t": pa.array(np.full(n, t), pa.int32()), "n": pa.array(np.diff(cut), pa.int64()), "body": pa.array(body, pa.binary())})


def unpack_tight(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """As unpack(), of rows that were packed tight; all columns are 64-bit."""
    t, n = table["t"].to_numpy(), table["n"].to_numpy()
    cols: list[list[np.ndarray]] = [[] for _ in range(columns)]
    for size, body in zip(n.tolist(), table["body"], strict=True):
        raw, at = body.as_buffer(), 0
        for i, col in enumerate(cols):
            values, at = unsqueeze(raw, size, at)
            col.append(np.cumsum(values, dtype=np.uint64) if i == 0 else values)
    return t, n, [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in cols]


def unpack(table: pa.Table, kinds: list[type]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """t and n of each row, and the columns that pack() was given (the key first), over all rows in order."""
    t, n = table["t"].to_numpy(), table["n"].to_numpy()
    cols: list[list[np.ndarray]] = [[] for _ in kinds]
    for size, body in zip(n.tolist(), table["body"], strict=True):
        raw, at = body.as_buffer(), 0
        for col, kind in zip(cols, kinds, strict=True):
            col.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
    return t, n, [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds, strict=True)]


def answers(asked: DataFrame, kind: int, kinds: list[type], answer: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """answer() gets the columns over all buckets, and returns a uint8 or bool for each entry."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        t, n, cols = unpack(table, kinds)
        out = answer(cols)
        bits = out.dtype == bool
        ends = np.cumsum(n)
        body = [(np.packbits(out[e - s : e]) if bits else out[e - s : e]).tobytes() for e, s in zip(ends.tolist(), n.tolist(), strict=True)]
        return pa.table({"t": pa.array(t, pa.int32()), "kind": pa.array(np.full(len(t), kind), pa.int32()), "p": pa.array(np.full(len(t), key[0].as_py()), pa.int32()), "body": pa.array(body, pa.binary())})

    return asked.groupBy("p").applyInArrow(work, REPLY)


def replies_of(replies: pa.Table, kind: int, keys: np.ndarray, ranges: int, dtype: type | None) -> np.ndarray:
    """The answers to a bucket's sorted keys, in their order; dtype None: squeezed integers."""
    used, cut = ranges_in(keys, ranges)
    of = {}
    for k, q, body in zip(replies["kind"].to_pylist(), replies["p"].to_pylist(), replies["body"].to_pylist(), strict=True):
        if k == kind:
            of[q] = body
    out = []
    for q, n in zip(used.tolist(), np.diff(cut).tolist(), strict=True):
        if dtype is None:
            out.append(unsqueeze(of[q], n)[0].astype(np.int64))
            continue
        raw = np.frombuffer(of[q], np.uint8)
        out.append(np.unpackbits(raw, count=n).astype(bool) if dtype is bool else raw.view(dtype))
    return np.concatenate(out) if out else np.zeros(0, dtype or np.int64)


def group_starts(*cols: np.ndarray) -> np.ndarray:
    """Mask of the first row of each run of equal rows."""
    n = len(cols[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new
