"""The full correlation of aligned chunks: rotation, transform, fractional delay, accumulation, calibration tones.

Samples are placed by their numbers, so a missing frame is a gap of zeros, and any run of windows can be worked on
alone.  A task holds one run of windows of one (block, channel); sums over runs are plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fringeline.operators import kernels
from fringeline.operators.correlate import STREAMS, added, dealt_in_triangle, groups_of, kept, met, normalised, summed

VIS = "acc int, source_id int, channel int, sp0 int, sp1 int, n_windows long, p0 double, p1 double, re array<double>, im array<double>"
FOLDED = "acc int, source_id int, channel int, sp int, bins int, shift long, n_samples long, re array<double>, im array<double>"
TONES = "acc int, source_id int, channel int, sp int, n_windows long, re array<double>, im array<double>"
#: Samples of a run of the calibration fold.
SPAN = 1 << 20


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c, kinds[t]) for c, t in (f.split() for f in schema.split(", "))])


def dequantised(raw: bytes, bits: int, is_complex: bool, skip: int = 0, count: int | None = None) -> np.ndarray:
    """Samples of stored components, without the first `skip`, and at most `count`."""
    per = 2 if is_complex else 1
    x = kernels.stored_levels(raw, bits)[skip * per : None if count is None else (skip + count) * per]
    return kernels.pairs(x[: len(x) // per * per]) if is_complex else x


def samples_of(r: dict) -> np.ndarray:
    return dequantised(r["samples"], r["bits"], r["is_complex"], r.get("skip") or 0, r["n_samples"])


class Stream:
    """Samples of one station and polarisation for some windows, with a margin for its delay's drift; gaps are 0."""

    def __init__(self, rows: list[dict], first: int, end: int, period: float, by_sample: bool = False):
        head = rows[0]
        self.fs, self.freq, self.side = head["fs"], head["freq_hz"], head["sideband"]
        self.is_complex, self.shift = head["is_complex"], head["shift"]
        self.coeffs = np.array([head["d0"], head["d1"], head["d2"]])
        self.moving = np.abs(self.coeffs).max() > 0
        self.by_sample = by_sample and self.moving
        margin = 0 if self.by_sample else kernels.drift(self.coeffs, self.fs, period, self.shift)
        self.low, high = first - margin, end + margin
        self.x = np.zeros(high - self.low, complex if self.is_complex else float)
        self.have = np.zeros(high - self.low, bool)
        for r in rows:
            x = samples_of(r)
            if self.by_sample:
                at, keep = kernels.moved(self.coeffs, self.fs, self.shift, r["first_sample"], len(x))
                keep &= (at >= self.low) & (at < high)
                self.x[at[keep] - self.low], self.have[at[keep] - self.low] = x[keep], True
                continue
            a, b = max(r["first_sample"], self.low), min(r["first_sample"] + len(x), high)
            if a < b:
                self.x[a - self.low : b - self.low] = x[a - r["first_sample"] : b - r["first_sample"]]
                self.have[a - self.low : b - self.low] = True

    def place(self, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Delay at each window's start, and where the whole samples of that delay put its first sample (a slip against the block's)."""
        d = kernels.delay(self.coeffs, windows * size / self.fs)
        slip = np.round(d * self.fs).astype(np.int64) - self.shift if self.moving and not self.by_sample else 0
        return d, windows * size + slip - self.low

    def filled(self, windows: np.ndarray, size: int) -> np.ndarray:
        """The windows that have a sample."""
        count = np.concatenate([[0], np.cumsum(self.have)])
        _, index = self.place(windows, size)
        return count[index + size] > count[index]

    def spectra(self, windows: np.ndarray, size: int, hanning: bool) -> np.ndarray:
        """Rotated spectra."""
        lower_complex = self.side == "L" and self.is_complex
        d, index = self.place(windows, size)
        x = self.x[index[:, None] + np.arange(size)]
        x = x * kernels.rotator(kernels.turns(self.freq, self.fs, kernels.delay(self.coeffs, (windows[:, None] * size + np.arange(size)) / self.fs), lower_complex))
        if hanning:
            x = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1)))
        f = np.fft.fft(x, axis=1)
        kind = "complex" if self.is_complex else ("lower" if self.side == "L" else "upper")
        if not self.is_complex:
            f = kernels.half_band(f, self.side)
        return kernels.fraction_rotate(f, kernels.fraction(d, self.fs), kind, size)


def off_shift(period: float) -> Column:
    """kernels.drift() of a chunk's block, as a column."""
    at = lambda t: F.abs((F.col("d0") + t * (F.col("d1") + t * F.col("d2"))) * F.col("fs") - F.col("shift"))
    turn = F.least(F.greatest(F.coalesce(F.try_divide(-F.col("d1"), 2 * F.col("d2")), F.lit(0.0)), F.lit(0.0)), F.lit(period))
    most = F.ceil(F.greatest(at(F.lit(0.0)), at(F.lit(period)), at(turn))) + 2
    return F.when((F.col("d0") == 0) & (F.col("d1") == 0) & (F.col("d2") == 0), 1).otherwise(most)


def partial_sums(rows: list[dict], lead: list, w: np.ndarray, *, fft_size: int, period: float, hanning: bool, pairs, by_sample: bool = False) -> list[list]:
    """Columns of VIS of the windows w of one (block, source, channel): spectra of all streams that rows hold, multiplied by pairs.

    pairs(ids) gives the places i <= k of the pairs to form.
    """
    size = fft_size * (1 if rows[0]["is_complex"] else 2)
    by: dict[int, list[dict]] = {}
    for r in rows:
        by.setdefault(r["station"] * 2 + r["pol"], []).append(r)
    ids = np.array(sorted(by))
    streams = [Stream(by[i], int(w[0]) * size, (int(w[-1]) + 1) * size, period, by_sample) for i in ids.tolist()]
    have = np.stack([s.filled(w, size) for s in streams])
    f = np.zeros((len(ids), len(w), fft_size), complex)
    for n, s in enumerate(streams):
        if have[n].any():
            f[n, have[n]] = s.spectra(w[have[n]], size, hanning)
    return summed(f, have, ids, *pairs(ids), lead)


def wanted_pairs(ids: np.ndarray, i: np.ndarray, k: np.ndarray, autos: bool, cross_polarisation: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs at places i and k those that the options keep."""
    some = kept(ids[i], ids[k], autos, cross_polarisation)
    return i[some], k[some]


def correlate(chunks: DataFrame, *, fft_size: int, period: float, windows_per_task: int = 1024, hanning: bool = False, normalise: bool = True, autos: bool = True, cross_polarisation: bool = True, streams: int | None = None, streams_per_task: int = STREAMS, by_sample: bool = False) -> DataFrame:
    """Visibilities acc, source_id, channel, sp0 <= sp1 (station * 2 + pol), k, re, im, n_windows of aligned chunks.

    Real streams use 2 fft_size samples a window and keep their half of the band, complex ones fft_size.  A pair's sums and
    its normaliser go over the windows of which both streams have a sample, so they depend neither on the size of a run nor
    on what other streams lack; partly filled windows count with zeros, and pairs without a window have no rows.  A run holds
    so many samples beside its windows as the delay drifts in its block, so a drift of any size is followed.  Pairs that
    are not wanted are not multiplied.  streams: how many there are at most (sp is below it); if they are more than
    streams_per_task, they are dealt in a triangle of tasks.

    by_sample: a stream slips at the sample where its delay passes half a sample, not at the next window: that sample is
    dropped, or a zero comes before it, and all later ones move.  How many have slipped before a sample is the change of
    the delay's whole samples since the block's shift, so no chunk waits for those before it, and chunks of any size give the same.
    """
    size = F.when(F.col("is_complex"), fft_size).otherwise(2 * fft_size)
    span = size * windows_per_task
    last = F.col("first_sample") + F.col("n_samples") - 1
    # a chunk goes to every run whose windows, wherever the drift puts them, touch its samples
    run = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("first_sample") - F.col("drift")) / span)), F.greatest(F.lit(0), F.floor((last + F.col("drift")) / span))))
    width, groups = groups_of(streams, streams_per_task)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        run, low, high = (x.as_py() for x in key[3:])
        total = int(round(period * rows[0]["fs"])) // (fft_size * (1 if rows[0]["is_complex"] else 2))
        w = np.arange(run * windows_per_task, min((run + 1) * windows_per_task, total))
        if not len(w):
            return arrow(VIS).empty_table()
        pairs = lambda ids: wanted_pairs(ids, *met(ids, low, high, width), autos, cross_polarisation)
        values = partial_sums(rows, [x.as_py() for x in key[:3]], w, fft_size=fft_size, period=period, hanning=hanning, pairs=pairs, by_sample=by_sample)
        return pa.table([pa.array(v, t.type) for v, t in zip(values, arrow(VIS), strict=True)], schema=arrow(VIS))

    dealt = dealt_in_triangle(chunks.withColumn("drift", off_shift(period)).withColumn("run", run), F.col("station") * 2 + F.col("pol"), width, groups)
    acc = added(dealt.groupBy("acc_block", "source_id", "channel", "run", "low", "high").applyInArrow(work, VIS), ("acc", "source_id", "channel"))
    return normalised(acc) if normalise else acc.drop("p0", "p1")


def calibration(chunks: DataFrame, *, per_bin: bool = False) -> DataFrame:
    """Calibration tones acc, source_id, channel, sp, k, re, im, n_windows: unrotated samples folded to one tone period, then transformed.

    Divided by the number of streams of the (block, channel) times the periods; per_bin: by bins times periods.  Runs of
    samples are folded apart and the folded periods added, so a task holds one run of one stream; streams without
    tones have no rows, and of chunks that begin at one sample one counts.
    """

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        rows = list({r["first_sample"]: r for r in table.to_pylist()}.values())  # a frame that comes twice counts once
        head = rows[0]
        bins = kernels.calibration_bins(head["fs"], head["freq_hz"], head["f_pcal"])
        total = np.zeros(bins, complex)
        for r in rows:
            total += kernels.fold(samples_of(r), r["first_sample"], bins)[0]
        values = [*(x.as_py() for x in key[:3]), key[3].as_py() * 2 + key[4].as_py(), bins, head["shift"], sum(r["n_samples"] for r in rows), total.real, total.imag]
        return pa.table([pa.array([v], t.type) for v, t in zip(values, arrow(FOLDED), strict=True)], schema=arrow(FOLDED))

    def transform(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["sp"])
        out = []
        for r in rows:
            n = max(r["n_samples"] // r["bins"], 1)
            v = sorted(r["v"], key=lambda x: x["k"])
            f = kernels.tones(np.array([complex(x["re"], x["im"]) for x in v]), r["shift"]) / (n * (r["bins"] if per_bin else len(rows)))
            out.append([*(x.as_py() for x in key), r["sp"], n, f.real, f.imag])
        return pa.table([pa.array(list(v), t.type) for v, t in zip(zip(*out, strict=True), arrow(TONES), strict=True)], schema=arrow(TONES))

    run = F.floor(F.col("first_sample") / SPAN)
    parts = chunks.where("f_pcal > 0").withColumn("run", run).groupBy("acc_block", "source_id", "channel", "station", "pol", "run").applyInArrow(fold, FOLDED)
    keys = ("acc", "source_id", "channel", "sp", "bins", "shift")
    each = parts.select(*keys, "n_samples", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    bins = each.groupBy(*keys, "k").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"), F.sum("n_samples").alias("n_samples"))
    whole = bins.groupBy(*keys).agg(F.collect_list(F.struct("k", "re", "im")).alias("v"), F.max("n_samples").alias("n_samples"))
    tones = whole.groupBy("acc", "source_id", "channel").applyInArrow(transform, TONES)
    return tones.select("acc", "source_id", "channel", "sp", "n_windows", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).select("acc", "source_id", "channel", "sp", "k", "v.re", "v.im", "n_windows")


def folded(rows: DataFrame, bins: int, keys: tuple[str, ...], *, shift: str = "0") -> DataFrame:
    """Sums and counts by bin of runs of samples (keys, first_sample, samples array<double>), rolled by the whole samples `shift`."""
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys) + ", bin int, s double, n long"

    def work(batches):
        for b in batches:
            lists, first, roll = b.column("samples"), b.column("first_sample").to_pylist(), b.column("roll").to_pylist()
            sums = [kernels.fold(x.values.to_numpy(zero_copy_only=False), f, bins) for x, f in zip(lists, first, strict=True)]
            s = [np.roll(x, r % bins) for (x, _), r in zip(sums, roll, strict=True)]
            n = [np.roll(x, r % bins) for (_, x), r in zip(sums, roll, strict=True)]
            out = [b.column(c).take(pa.array(np.repeat(np.arange(b.num_rows), bins))) for c in keys]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.tile(np.arange(bins), b.num_rows), pa.int32()), pa.array(np.concatenate(s), pa.float64()), pa.array(np.concatenate(n), pa.int64())], names=[*keys, "bin", "s", "n"])

    found = rows.select(*keys, "first_sample", "samples", F.expr(shift).cast("long").alias("roll")).mapInArrow(work, schema)
    return found.groupBy(*keys, "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def toned(bins: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Spectrum of folded periods (keys, bin, s, n) divided by the number of their samples: keys, k, re, im."""
    kinds = dict(bins.dtypes)
    whole = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "s"))).alias("v"), F.sum("n").alias("n")).select(*keys, F.col("v.s").alias("v"), "n")

    def work(batches):
        for b in batches:
            f = [kernels.tones(x.values.to_numpy(zero_copy_only=False)) / n for x, n in zip(b.column("v"), b.column("n").to_pylist(), strict=True)]
            size = [len(x) for x in f]
            out = [b.column(c).take(pa.array(np.repeat(np.arange(b.num_rows), size))) for c in keys]
            f = np.concatenate([*f, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*out, pa.array([k for n in size for k in range(n)], pa.int32()), pa.array(f.real), pa.array(f.imag.astype(float))], names=[*keys, "k", "re", "im"])

    return whole.mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", k int, re double, im double")


def stream_summary(chunks: DataFrame) -> DataFrame:
    """What there is of each stream of a block and channel, in one pass: counts, ends, and head, the fields of its first chunk."""
    head = F.min_by(F.struct("shift", "frac", "d0", "d1", "d2", "n_samples", "fs", "bits", "first_sample", "is_complex", "freq_hz", "sideband"), "first_sample")
    g = chunks.groupBy("acc_block", "channel", "station", "pol")
    return g.agg(F.count("*").alias("n_chunks"), F.sum("n_samples").alias("n_total"), F.max(F.col("first_sample") + F.col("n_samples")).alias("last_sample"), F.min("first_sample").alias("first"), head.alias("head"))


def statistics_of(summary: DataFrame) -> DataFrame:
    return summary.withColumn("n_missing", F.col("last_sample") - F.col("first") - F.col("n_total")).drop("first", "head")


def stream_statistics(chunks: DataFrame) -> DataFrame:
    """Samples, chunks, last sample and missing samples of each stream of a block and channel."""
    g = chunks.groupBy("acc_block", "channel", "station", "pol")
    out = g.agg(F.count("*").alias("n_chunks"), F.sum("n_samples").alias("n_total"), F.max(F.col("first_sample") + F.col("n_samples")).alias("last_sample"), F.min("first_sample").alias("first"))
    return statistics_of(out.withColumn("head", F.lit(None)))


def dismissed(chunks: DataFrame, streams: int) -> DataFrame:
    """Blocks and channels that have fewer than so many streams (rows of chunks or of a summary): no pair of theirs with the others is formed."""
    found = chunks.groupBy("acc_block", "channel").agg(F.countDistinct("station", "pol").alias("streams"))
    return found.where(F.col("streams") < streams)


HEADS = ("acc_block", "source_id", "channel", "station", "pol", "first_sample", "n_samples")
SESSIONS = "acc_block int, source_id int, channel int, station int, pol int, first_sample long, n_samples int, session int, streams int"


def sessions(chunks: DataFrame) -> DataFrame:
    """Heads of chunks with session, counted from 1, and the streams of that session.

    Chunks of a block and channel come in order of their first samples, then of their streams; a session ends where a stream
    comes again.  Only heads are brought together, some forty bytes a chunk of one block and channel; samples stay.
    """

    def work(table: pa.Table) -> pa.Table:
        sp = table["station"].to_numpy() * 2 + table["pol"].to_numpy()
        order = np.lexsort((sp, table["first_sample"].to_numpy()))
        session, number, now = np.zeros(len(sp), np.int32), 0, set(sp.tolist())
        for i, s in zip(order.tolist(), sp[order].tolist(), strict=True):
            if s in now:
                number, now = number + 1, set()
            now.add(s)
            session[i] = number
        count = np.bincount(session).astype(np.int32)
        return table.append_column("session", pa.array(session)).append_column("streams", pa.array(count[session]))

    return chunks.select(*HEADS).groupBy("acc_block", "source_id", "channel").applyInArrow(work, SESSIONS)


STREAM = ("acc_block", "source_id", "channel", "station", "pol")


def places(chunks: DataFrame, streams: int) -> DataFrame:
    """Chunks of sessions with so many streams: the stream's columns, first_sample, session, and place, the stream's samples before in such chunks.

    A chunk that comes in several sessions counts once, in the first that is whole.  Places are running sums over heads.
    """
    whole = sessions(chunks).where(F.col("streams") >= streams).groupBy(*STREAM, "first_sample").agg(F.max("n_samples").alias("size"), F.min("session").alias("session"))
    before = Window.partitionBy(*STREAM).orderBy("first_sample").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select(*STREAM, "first_sample", "session", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("place"))


def compacted(chunks: DataFrame, streams: int) -> DataFrame:
    """chunks of sessions with so many streams, their samples numbered on from those kept before: gaps close, and streams align by rank.

    Chunks of other sessions are dismissed.  The result can be correlated like chunks without gaps.
    """
    found = places(chunks, streams).drop("session")
    return chunks.join(found, [*STREAM, "first_sample"]).withColumn("first_sample", F.col("place")).select(chunks.columns)


def counted(frames: DataFrame, observation: Observation) -> DataFrame:
    """frames, counted while something else reads them: frames, bytes, truncated and invalid ones.

    The counts are in observation.get once the pass that reads the frames has ended; they cost no pass of their own.
    """
    return frames.observe(observation, F.count("*").alias("frames"), F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("bytes"), F.count_if(~F.col("complete")).alias("truncated"), F.count_if("invalid").alias("invalid"))


def gaps(chunks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Missing stretches of each stream: where the samples before end, where the next ones begin, and the samples between."""
    end = F.max(F.col("first_sample") + F.col("n_samples")).over(Window.partitionBy(*keys).orderBy("first_sample").rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumn("before_end", end).where("first_sample > before_end")
    return rows.select(*keys, F.col("first_sample").alias("first"), "before_end", (F.col("first_sample") - F.col("before_end")).alias("gap"))


def usable(lengths: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Shortest and longest of the streams' lengths n, and the samples of whole windows that all of them have."""
    out = lengths.groupBy(*keys).agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return out.withColumn("used", F.floor(F.col("shortest") / size) * size)
