"""Seeded sample streams as frames: noise that all stations see, their own noise, calibration tones, whole delays, and a filter bank.

A block of the common noise is drawn from a generator seeded by its number, so any frame can be made by itself and the
frames of all stations agree wherever they are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeline.operators.kernels import LEVELS
from fringeline.sources import vdif
from fringeline.sources.folders import write_files

#: Samples that one seed gives.
BLOCK = 4096


@dataclass(frozen=True)
class Signal:
    """What a station records: real samples at fs of `channels` bands, as frames of spf samples a band."""

    fs: float
    spf: int
    seconds: int
    bits: int = 2
    channels: int = 1
    noise: float = 0.5
    tone: float = 0.0
    f_pcal: float = 0.0
    epoch: int = 30
    first_second: int = 0
    seed: int = 1

    @property
    def frames_per_second(self) -> int:
        return round(self.fs / self.spf)


def noise(seed: tuple[int, ...], first: int, count: int) -> np.ndarray:
    """Normal noise numbers first to first + count of the stream of this seed; numbers may be negative."""
    out = []
    for b in range(first // BLOCK, (first + count - 1) // BLOCK + 1):
        x = np.random.default_rng([*seed, b + (1 << 40)]).normal(size=BLOCK)
        out.append(x[max(first - b * BLOCK, 0) : max(min(first + count - b * BLOCK, BLOCK), 0)])
    return np.concatenate(out)


def filter_bank(x: np.ndarray, channels: int) -> np.ndarray:
    """Real samples of `channels` bands, a row each, at x's rate over their number, from a transform of the whole of x.

    Band c holds the frequencies from c to c + 1 channels' widths; the bands together hold all of x.
    """
    n = len(x) // (2 * channels) * (2 * channels)
    spectrum = np.fft.rfft(x[:n])
    width = n // (2 * channels)
    rows = np.zeros((channels, width + 1), complex)
    for c in range(channels):
        rows[c, : width + 1] = spectrum[c * width : (c + 1) * width + 1]
    return np.fft.irfft(rows, 2 * width, axis=1) / np.sqrt(channels)


def samples(s: Signal, station: int, channel: int, late: int, first: int) -> np.ndarray:
    """Samples of one frame and band: the sky `late` samples ago, the station's own noise, and tones every f_pcal."""
    x = noise((s.seed, channel), first - late, s.spf) + s.noise * noise((s.seed, channel, station + 1), first, s.spf)
    if s.tone and s.f_pcal:
        t = (first + np.arange(s.spf)) / s.fs
        for k in range(1, int(s.fs / 2 / s.f_pcal) + 1):
            x = x + s.tone * np.cos(2 * np.pi * k * s.f_pcal * t)
    return x


def quantised(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of the nearest levels; the largest is at three standard deviations, or as the two-bit table has it."""
    if bits == 1:
        return (x > 0).astype(np.uint32)
    if bits == 2:
        return np.digitize(x / x.std(), (LEVELS[1:] + LEVELS[:-1]) / 2 / LEVELS[3] * 1.5).astype(np.uint32)
    top = (1 << bits) - 1
    return np.clip(np.rint((x / (3 * x.std()) + 1) / 2 * top), 0, top).astype(np.uint32)


def frames(spark: SparkSession, s: Signal, delays: dict[int, int]) -> DataFrame:
    """station, nr and body of every frame of each station, delayed by whole samples; made where they are needed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for station, late, nr in zip(*(b.column(c).to_pylist() for c in ("station", "late", "nr")), strict=True):
                q = np.stack([quantised(samples(s, station, c, late, nr * s.spf), s.bits) for c in range(s.channels)], 1)
                second, place = divmod(nr, s.frames_per_second)
                out.append(vdif.frame(q.ravel(), bits=s.bits, channels=s.channels, seconds=s.first_second + second, frame_num=place, epoch=s.epoch, station_code=station))
            yield pa.RecordBatch.from_arrays([b.column("station"), b.column("nr"), pa.array(out, pa.binary())], names=["station", "nr", "body"])

    stations = spark.createDataFrame(sorted(delays.items()), "station int, late long")
    rows = stations.withColumn("nr", F.explode(F.expr(f"sequence(0L, {s.seconds * s.frames_per_second - 1}L)")))
    return rows.repartition("station").mapInArrow(work, "station int, nr long, body binary")


def write(spark: SparkSession, s: Signal, delays: dict[int, int], path: str) -> None:
    """A file of frames for each station, station-N.vdif, in the folder `path`; one task a station."""
    rows = frames(spark, s, delays).repartition("station").sortWithinPartitions("station", "nr")
    write_files(rows.select(F.format_string("station-%d.vdif", "station").alias("file"), "body"), path)
