"""Correlation of sample streams.

streams: acc INT, channel INT, sp INT, w LONG, samples ARRAY<DOUBLE>, one row for each window of a stream.  Windows
carry absolute indices, so any block of windows can be correlated by itself: one shuffle brings the streams of a
(acc, channel, block) together, a task holds one block, and the partial sums are added by a plain aggregate.
A pair's sums go over the windows that both of its streams have, whatever other streams lack; so do the powers that
normalise it, which are added beside the sums, as the normaliser is not linear and comes after the last sum.

Many streams are dealt in a triangle: groups of streams, and a task for each two groups, so that every pair meets once,
a task holds two groups at most, and a stream is sent to as many tasks as there are groups (about the square root of
twice the tasks).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeline.operators import kernels

BLOCK = 256
PARTIAL = "acc int, channel int, sp0 int, sp1 int, n_windows long, p0 double, p1 double, re array<double>, im array<double>"
#: Streams of a task.
STREAMS = 64


def kept(sp0: np.ndarray, sp1: np.ndarray, autos: bool = True, cross_polarisation: bool = True) -> np.ndarray:
    """Pairs to form: without those of one station, or those of different polarisations, on demand."""
    return (autos | (sp0 // 2 != sp1 // 2)) & (cross_polarisation | (sp0 % 2 == sp1 % 2))


def pairs(spark: SparkSession, streams: int) -> DataFrame:
    """Every pair s0 <= s1 of streams, whether it is of one station, and whether of one polarisation."""
    a = spark.range(streams).select(F.col("id").cast("int").alias("s0"))
    rows = a.select("s0", F.explode(F.sequence("s0", F.lit(streams - 1))).alias("s1"))
    return with_kind(rows)


def with_kind(rows: DataFrame) -> DataFrame:
    """Pairs s0, s1 with kind (auto: of one station, else cross) and pols (same or mixed)."""
    kind = F.when(F.floor(F.col("s0") / 2) == F.floor(F.col("s1") / 2), "auto").otherwise("cross")
    return rows.withColumn("kind", kind).withColumn("pols", F.when(F.col("s0") % 2 == F.col("s1") % 2, "same").otherwise("mixed"))


def pairs_of(streams: DataFrame, keys: tuple[str, ...], stream: str = "sp") -> DataFrame:
    """keys, s0 and s1: every pair s0 <= s1 of the streams that share their keys; of repeated rows one counts."""
    rows = streams.select(*keys, stream).distinct()
    return rows.withColumnRenamed(stream, "s0").join(rows.withColumnRenamed(stream, "s1"), list(keys)).where("s0 <= s1")


def task_of(s0: Column, s1: Column) -> Column:
    """The stream whose task forms a pair, so that all tasks have nearly as many and every pair has one."""
    return F.when((s0 + s1) % 2 == 0, s0).otherwise(s1)


def groups_of(streams: int | None, streams_per_task: int) -> tuple[int, int]:
    """Streams of a group, and groups, so that a task of two groups has no more than so many streams."""
    if streams is None or streams <= streams_per_task:
        return 1 << 30, 1
    width = max(1, streams_per_task // 2)
    return width, -(-streams // width)


def dealt_in_triangle(rows: DataFrame, sp: Column, width: int, groups: int) -> DataFrame:
    """rows with low and high, the groups of each task that forms pairs of the row's stream: once for each other group."""
    if groups == 1:
        return rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    own = F.floor(sp / width).cast("int")
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return out.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other")


def met(ids: np.ndarray, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i <= k of a task's rising streams that meet in it: of one group in the task of that group alone, else across."""
    i, k = np.triu_indices(len(ids))
    here = (ids[i] // width == low) & (ids[k] // width == high)
    return i[here], k[here]


def summed(f: np.ndarray, have: np.ndarray, ids: np.ndarray, i: np.ndarray, k: np.ndarray, lead: list) -> list[list]:
    """Columns of a task's partial sums: `lead` repeated, then the pairs that share a window; f is zero where have is false."""
    n, p0, p1 = kernels.shared(f, have, i, k)
    some = n > 0
    i, k = i[some], k[some]
    acc = kernels.products(f, i, k)
    return [[x] * len(i) for x in lead] + [ids[i], ids[k], n[some], p0[some], p1[some], list(acc.real), list(acc.imag)]


def window_sums(table: pa.Table, pairs: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], *, transform: Callable | None = None, hanning: bool = False, keep: Callable | None = None) -> pa.Table:
    """PARTIAL of the windows (acc, channel, sp, w, samples) of one accumulation and channel; pairs(ids) gives the places of the pairs to form."""
    sp, w = table["sp"].to_numpy(), table["w"].to_numpy()
    samples = table["samples"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    order = np.lexsort((w, sp))
    order = order[np.append((np.diff(sp[order]) != 0) | (np.diff(w[order]) != 0), True)]
    ids, all_w = np.unique(sp), np.unique(w)
    f, have = None, np.zeros((len(ids), len(all_w)), bool)
    for n, s in enumerate(ids.tolist()):
        rows = order[sp[order] == s]
        x = samples[rows]
        own = transform(x, s, w[rows]) if transform else kernels.spectra(x.ravel(), x.shape[1], hanning=hanning)
        if f is None:
            f = np.zeros((len(ids), len(all_w), own.shape[1]), complex)
        at = np.searchsorted(all_w, w[rows])
        have[n, at], f[n, at] = True, own
    i, k = pairs(ids)
    if keep is not None:
        some = keep(ids[i], ids[k])
        i, k = i[some], k[some]
    columns = summed(f, have, ids, i, k, [table["acc"][0].as_py(), table["channel"][0].as_py()])
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.float64(), pa.float64()] + [pa.list_(pa.float64())] * 2
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PARTIAL.split(", ")])


def accumulated(streams: DataFrame, *, transform: Callable[[np.ndarray, int, np.ndarray], np.ndarray] | None = None, hanning: bool = False, block: int = BLOCK, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, count: int | None = None, streams_per_task: int = STREAMS) -> DataFrame:
    """Sums over windows of F_i conj(F_k): acc, channel, sp0 <= sp1, k, re, im, n_windows, and p0, p1, the streams' powers.

    transform(samples (window, n), sp, window numbers) gives the spectra; by default a Fourier transform.  A pair's sums
    are over the windows that both streams have, so they depend neither on `block` nor on other streams; pairs without
    such a window have no rows.  Of a window that comes twice one counts.  keep(sp0, sp1) tells which pairs are formed; by
    default all.  count: how many streams there are at most (sp is below it); more than streams_per_task are dealt in a triangle.
    """
    width, groups = groups_of(count, streams_per_task)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        return window_sums(table, lambda ids: met(ids, key[3].as_py(), key[4].as_py(), width), transform=transform, hanning=hanning, keep=keep)

    dealt = dealt_in_triangle(streams.withColumn("block", F.floor(F.col("w") / block)), F.col("sp"), width, groups)
    return added(dealt.groupBy("acc", "channel", "block", "low", "high").applyInArrow(work, PARTIAL), ("acc", "channel"))


def added(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Partial sums of tasks added by pair and coefficient."""
    pair = [*keys, "sp0", "sp1"]
    rows = parts.select(*pair, "n_windows", "p0", "p1", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    return rows.groupBy(*pair, "k").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"), *(F.sum(c).alias(c) for c in ("n_windows", "p0", "p1")))


def normalised(acc: DataFrame) -> DataFrame:
    """re and im divided by the geometric mean of the powers of the pair's streams over its windows; null where one has none."""
    scale = F.sqrt(F.nullif(F.col("p0") * F.col("p1"), F.lit(0.0)))
    return acc.withColumn("re", F.col("re") / scale).withColumn("im", F.col("im") / scale).drop("p0", "p1")


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
