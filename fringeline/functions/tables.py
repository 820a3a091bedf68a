"""Table functions for SQL: the correlator's kernels over TABLE arguments that are partitioned by their keys.

After register(spark):

    SELECT acc, channel, sp0, sp1, SUM(n_windows) ...
    FROM correlate_windows(TABLE(SELECT acc, channel, sp, w, samples, w DIV 256 AS run FROM streams) PARTITION BY (acc, channel, run))

Spark shuffles by the partition's columns, and a partition is what a task of the DataFrame operator holds, so sums over
runs are plain SQL aggregates here too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from fringeline.operators import kernels
from fringeline.operators.correlate import PARTIAL, window_sums
from fringeline.sources import vdif

FOLDED = "acc long, bin int, s double, n long"
COMPONENTS = "id long, i int, q int"


class Gathered:
    """Keeps the batches of a partition; at its end they are one table."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self.batches.append(batch)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.batches:
            yield self.worked(pa.Table.from_batches(self.batches))


@arrow_udtf(returnType=PARTIAL)
class CorrelateWindows(Gathered):
    """Partial sums of all pairs of a partition's streams: acc, channel, sp, w, samples, of one acc and channel."""

    def worked(self, table: pa.Table) -> pa.Table:
        table = table.set_column(table.schema.get_field_index("samples"), "samples", table["samples"].cast(pa.list_(pa.float64())))
        return window_sums(table, lambda ids: np.triu_indices(len(ids)))


@arrow_udtf(returnType=FOLDED)
class FoldPeriod(Gathered):
    """Sums and counts by bin of samples (acc, n, x, bins) by their number n modulo bins; of one acc."""

    def worked(self, table: pa.Table) -> pa.Table:
        bins = table["bins"][0].as_py()
        at, x = table["n"].to_numpy() % bins, table["x"].to_numpy()
        return pa.table({"acc": pa.array([table["acc"][0].as_py()] * bins, pa.int64()), "bin": pa.array(np.arange(bins), pa.int32()), "s": np.bincount(at, x, bins), "n": np.bincount(at, minlength=bins)})


@arrow_udtf(returnType=COMPONENTS)
class UnpackWords:
    """The components q, numbered i, of 32-bit words (id, word, bits), from the lowest bits up; batches are worked on as they come."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if batch.num_rows:
            bits = batch.column("bits")[0].as_py()
            q = vdif.unpack(batch.column("word").to_numpy(zero_copy_only=False).astype("<u4").tobytes(), bits)
            per = 32 // bits
            yield pa.table({"id": np.repeat(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), per), "i": np.tile(np.arange(per, dtype=np.int32), batch.num_rows), "q": q.astype(np.int32)})


@arrow_udtf(returnType="acc long, k int, re double, im double")
class TonesOf(Gathered):
    """The spectrum of one folded period (acc, bin, s, n) divided by the number of its samples; of one acc."""

    def worked(self, table: pa.Table) -> pa.Table:
        s = np.zeros(table.num_rows)
        s[table["bin"].to_numpy()] = table["s"].to_numpy()
        f = kernels.tones(s) / max(int(table["n"].to_numpy().sum()), 1)
        return pa.table({"acc": pa.array([table["acc"][0].as_py()] * len(f), pa.int64()), "k": np.arange(len(f), dtype=np.int32), "re": f.real.copy(), "im": f.imag.copy()})


FUNCTIONS = {"correlate_windows": CorrelateWindows, "fold_period": FoldPeriod, "unpack_words": UnpackWords, "tones_of": TonesOf}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
