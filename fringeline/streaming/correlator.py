"""The correlator of a stream of aligned chunks: state by block, source and channel, closed by event time.

The state of a key holds the samples that are still needed, packed as they came, and the partial sums of its pairs.  What
comes is multiplied with what is held before anything is stored, so samples that wait for nothing never enter the state.
Windows are multiplied as soon as all expected streams have them, or as the watermark says that nothing more can come for
them; the samples before are dropped then.  A timer closes the block: what is left is multiplied as it is, gaps counting
as in the batch correlator, and the sums go out.  So the sums are those of the batch, however the chunks are split into
micro-batches, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fringeline.operators.correlate import added, normalised
from fringeline.operators.fx import VIS, Stream, partial_sums, wanted_pairs

#: State in RocksDB, which keeps maps by key and timers.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK_KEY = "sp int, first_sample long"
CHUNK = "n_samples int, skip int, bits int, is_complex boolean, fs double, freq_hz double, sideband string, shift long, d0 double, d1 double, d2 double, samples binary"
NAMES = [c.split()[0] for c in CHUNK.split(", ")]
#: Of all pairs in one value; re and im are a row of doubles for each pair.
SUMS = "sp0 array<int>, sp1 array<int>, n_windows array<long>, p0 array<double>, p1 array<double>, re binary, im binary"


class Correlator(StatefulProcessor):
    def __init__(self, *, fft_size: int, period: float, start: float, streams: int, hanning: bool, autos: bool, cross_polarisation: bool):
        self.fft_size, self.period, self.start, self.streams, self.hanning = fft_size, period, start, streams, hanning
        self.options = autos, cross_polarisation

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", CHUNK_KEY, CHUNK)
        self.sums = handle.getValueState("sums", SUMS)
        self.done = handle.getValueState("done", "windows long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = self.done.exists()
        done, chunks = (self.done.get()[0], self.held()) if begun else (0, {})
        if not begun:
            self.handle.registerTimer(int(np.ceil((self.start + (key[0] + 1) * self.period) * 1000)))
        stored, come = set(chunks), set()
        for frame in rows:
            for r in frame.to_dict("records"):
                at = int(r["station"]) * 2 + int(r["pol"]), int(r["first_sample"])
                chunks[at] = r
                come.add(at)
        mark = timerValues.getCurrentWatermarkInMs() / 1000 - self.start - key[0] * self.period
        all_ = [chunks[at] for at in sorted(chunks)]
        end, left = self.advanced(all_, done, mark), set(chunks)
        if end > done:
            self.store(self.multiplied(key, all_, done, end))
            left = self.needed(chunks, end)
        if end > done or not begun:
            self.done.update((end,))
        for at in come & left:
            self.chunks.updateValue(at, tuple(chunks[at][c] for c in NAMES))
        for at in stored - left:
            self.chunks.removeKey(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunks = self.held()
        rows = [chunks[at] for at in sorted(chunks)]
        done = self.done.get()[0]
        sums = self.multiplied(key, rows, done, self.total(rows)) if rows and self.total(rows) > done else self.summed()
        for state in (self.chunks, self.sums, self.done):
            state.clear()
        found = [[*key, *pair, int(n), float(p0), float(p1), re.tolist(), im.tolist()] for pair, (n, p0, p1, re, im) in sums.items()]
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in VIS.split(", ")])

    def close(self) -> None:
        pass

    def held(self) -> dict[tuple[int, int], dict]:
        """Chunks of the state by stream and first sample, as the batch correlator gets them."""
        return {(sp, first): dict(zip(NAMES, value, strict=True)) | {"station": sp // 2, "pol": sp % 2, "first_sample": first} for (sp, first), value in self.chunks.iterator()}

    def summed(self) -> dict[tuple[int, int], tuple]:
        """n_windows, p0, p1, re and im of each pair so far."""
        if not self.sums.exists():
            return {}
        *columns, re, im = self.sums.get()
        table = lambda b: np.frombuffer(b, float).reshape(len(columns[0]), -1)
        return {(sp0, sp1): (n, p0, p1, x, y) for sp0, sp1, n, p0, p1, x, y in zip(*columns, table(re), table(im), strict=True)} if columns[0] else {}

    def store(self, sums: dict[tuple[int, int], tuple]) -> None:
        rows = [(*pair, *value) for pair, value in sums.items()]
        kinds = (int, int, int, float, float)
        packed = lambda i: np.array([r[i] for r in rows], float).tobytes()
        self.sums.update((*([kind(r[i]) for r in rows] for i, kind in enumerate(kinds)), packed(5), packed(6)))

    def size(self, rows: list[dict]) -> int:
        return self.fft_size * (1 if rows[0]["is_complex"] else 2)

    def total(self, rows: list[dict]) -> int:
        return int(round(self.period * rows[0]["fs"])) // self.size(rows)

    def advanced(self, rows: list[dict], done: int, mark: float) -> int:
        """Where the windows end that are whole in all streams, or before the watermark (seconds of the block), from the first open one on."""
        size = self.size(rows)
        w = np.arange(done, min(self.total(rows), max(r["first_sample"] + r["n_samples"] for r in rows) // size + 2))
        by: dict[int, list[dict]] = {}
        for r in rows:
            by.setdefault(r["station"] * 2 + r["pol"], []).append(r)
        if not len(w):
            return done
        ready = np.full(len(w), len(by) >= self.streams)
        past = np.ones(len(w), bool)
        for own in by.values():
            s = Stream(own, int(w[0]) * size, (int(w[-1]) + 1) * size, self.period)
            index = s.place(w, size)[1]
            count = np.concatenate([[0], np.cumsum(s.have)])
            begin = np.maximum(index, -s.low)  # before the block's first sample nothing comes
            ready &= count[np.maximum(index + size, begin)] - count[begin] == np.maximum(index + size - begin, 0)
            past &= index + size + s.low <= mark * s.fs
        # a stream that has not begun may come with any delay: only the watermark of the whole block tells
        past &= len(by) >= self.streams
        open_ = np.flatnonzero(~(ready | past))
        return int(w[open_[0]]) if len(open_) else int(w[-1]) + 1

    def multiplied(self, key: tuple, rows: list[dict], done: int, end: int) -> dict[tuple[int, int], tuple]:
        """The sums with the windows from the first open one to `end`."""
        pairs = lambda ids: wanted_pairs(ids, *np.triu_indices(len(ids)), *self.options)
        columns = partial_sums(rows, list(key), np.arange(done, end), fft_size=self.fft_size, period=self.period, hanning=self.hanning, pairs=pairs)
        sums = self.summed()
        for _, _, _, sp0, sp1, *value in zip(*columns, strict=True):
            value = (*value[:3], np.asarray(value[3], float), np.asarray(value[4], float))
            old = sums.get((int(sp0), int(sp1)))
            sums[int(sp0), int(sp1)] = tuple(x + y for x, y in zip(value, old, strict=True)) if old else value
        return sums

    def needed(self, chunks: dict[tuple[int, int], dict], end: int) -> set[tuple[int, int]]:
        """The chunks with samples that windows from `end` on need."""
        lows: dict[int, int] = {}
        left = set()
        for (sp, first), r in sorted(chunks.items(), key=lambda x: x[0]):
            if sp not in lows:
                at = end * self.size([r])
                lows[sp] = Stream([r | {"n_samples": 0, "samples": b""}], at, at, self.period).low
            if first + r["n_samples"] > lows[sp]:
                left.add((sp, first))
        return left


def correlated_stream(chunks: DataFrame, *, fft_size: int, period: float, start: float, streams: int, late: str = "10 seconds", hanning: bool = False, autos: bool = True, cross_polarisation: bool = True) -> DataFrame:
    """Partial sums (fx.VIS) of a stream of aligned chunks, a row for each pair of each block, once the block is closed.

    start: the scan's begin in seconds of the event time, streams: how many a channel has.  A block closes when chunks
    have come that begin more than `late` after its end; chunks later than that are dropped, and counted by late_rows().  Pass
    the rows of a sink to visibilities().
    """
    rows = chunks.withColumn("ts", F.timestamp_seconds(F.lit(start) + F.col("acc_block") * F.lit(period) + F.col("first_sample") / F.col("fs"))).withWatermark("ts", late)
    rows = rows.select("acc_block", "source_id", "channel", "station", "pol", "first_sample", *NAMES, "ts")
    work = Correlator(fft_size=fft_size, period=period, start=start, streams=streams, hanning=hanning, autos=autos, cross_polarisation=cross_polarisation)
    return rows.groupBy("acc_block", "source_id", "channel").transformWithStateInPandas(work, outputStructType=VIS, outputMode="Append", timeMode="EventTime")


def visibilities(parts: DataFrame, *, normalise: bool = True) -> DataFrame:
    """Visibilities, as fx.correlate() gives them, of the rows that correlated_stream() has written."""
    acc = added(parts, ("acc", "source_id", "channel"))
    return normalised(acc) if normalise else acc.drop("p0", "p1")


def written_stream(rows: DataFrame, table: str, checkpoint: str) -> list[dict]:
    """Appends what there is of a stream to a Parquet table, and gives the progress of the run; the next run goes on from there."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        query = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]


def late_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark and were dropped, over a run's micro-batches."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p.get("stateOperators", []))


def read_written(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(VIS).parquet(table)
