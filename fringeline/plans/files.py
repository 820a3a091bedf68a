"""Queries that go through binary files: written by the sinks into the shared folder, read by the data sources, compared."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeline.operators import samples
from fringeline.operators.correlate import accumulated
from fringeline.plans.templates import duckdb_sql
from fringeline.plans.views import streams, table
from fringeline.sources import results, vdif
from fringeline.sources.folders import local_path, shared_folder, write_parts


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_frames(spark: SparkSession, sf_dir: str, per_second: int = 1000) -> str:
    """A folder of files of frames: vectors quantised to two bits, so many a second."""

    def framed(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        q = np.clip(np.floor(c["embedding"].astype(float) * 4 + 2), 0, 3).astype(np.uint32)
        return {"body": pa.array([vdif.frame(x, bits=2, seconds=int(v) // per_second, frame_num=int(v) % per_second, epoch=30, station_code=int(v) % 4) for x, v in zip(q, c["vec_id"], strict=True)], pa.binary())}

    folder = own_folder(spark, "frames")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    write_parts(samples.mapped(rows, {"body": T.BinaryType()}, framed, ("vec_id", "embedding")), [F.col("vec_id")], folder)
    return folder


def totals(frames: DataFrame, per_second: int = 1000) -> DataFrame:
    levels = F.aggregate("q", F.lit(0), lambda a, x: a + x)
    return samples.unpacked(frames, 2).select((F.col("seconds") * per_second + F.col("frame_num")).cast("long").alias("vec_id"), F.size("q").alias("n"), levels.alias("total"))


def vdif_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors quantised to two bits, written as frames, read and unpacked: samples and the sum of levels of each."""
    return totals(vdif.read_folder(spark, local_path(written_frames(spark, sf_dir)), frames_per_partition="500"))


def vdif_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames, split into records by the JVM from whatever store the shared folder is in."""
    return totals(vdif.read_records(spark, [f"{written_frames(spark, sf_dir)}/*"]))


def vdif_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as a stream of the folder's files, kept as a table."""
    folder, out = local_path(written_frames(spark, sf_dir)), own_folder(spark, "kept")
    query = vdif.stream_frames(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", own_folder(spark, "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    return totals(spark.read.schema(vdif.SCHEMA).parquet(out))


def vdif_time_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds 20 to 29 of frames that come ten a second: ranges outside are found by their headers and not read."""
    folder = local_path(written_frames(spark, sf_dir, 10))
    return totals(vdif.read_folder(spark, folder, ordered="true", slack="10", t_start="20", t_end="30"), 10)


def peaks(records: DataFrame) -> DataFrame:
    size = F.array_max(F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"])))
    return records.select(F.floor("seconds").cast("int").alias("acc"), "st0", "st1", "pols", F.round(size.cast("double"), 1).alias("peak"))


def swin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities written as binary records and read again: the largest coefficient of each."""
    folder = own_folder(spark, "records")
    results.write_swin(results.spectra_rows(accumulated(streams(spark, sf_dir))), folder, mjd=57350, start=0.0, period=1.0)
    return peaks(results.read_swin(spark, folder, 64))


def swin_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as one file, of which two periods and two polarisation pairs are read."""
    file = own_folder(spark, "records")
    results.write_swin_file(results.spectra_rows(accumulated(streams(spark, sf_dir))), file, mjd=57350, start=0.0, period=1.0, parts=4)
    return peaks(results.read_swin(spark, file, 64, pols="XX,YX", t_start="57350:1", t_end="57350:3"))


QUERIES = {f.__name__: f for f in (vdif_roundtrip, vdif_records, vdif_stream, vdif_time_pruned, swin_roundtrip, swin_merged)}


def _sql() -> dict[str, str]:
    from fringeline.plans.correlation import RAW

    quantised = "SELECT vec_id, CAST(64 AS INT) n, CAST(list_sum(list_transform(embedding, lambda x: least(3, greatest(0, floor(CAST(x AS DOUBLE) * 4 + 2))))) AS INT) total FROM embeddings"
    records = f"{RAW} SELECT acc, CAST(floor(sp0 / 2) AS INT) st0, CAST(floor(sp1 / 2) AS INT) st1, CASE WHEN sp0 % 2 = 0 THEN 'X' ELSE 'Y' END || CASE WHEN sp1 % 2 = 0 THEN 'X' ELSE 'Y' END pols, round(max(sqrt(re * re + im * im)), 1) peak FROM v WHERE {{wanted}} GROUP BY acc, sp0, sp1"
    return dict.fromkeys(("vdif_roundtrip", "vdif_records", "vdif_stream"), quantised) | {
        "vdif_time_pruned": f"{quantised} WHERE vec_id >= 200 AND vec_id < 300",
        "swin_roundtrip": records.replace("{wanted}", "true"),
        "swin_merged": records.replace("{wanted}", "acc IN (1, 2) AND sp1 % 2 = 0"),
    }


ORACLE_SQL = {name: duckdb_sql(text) for name, text in _sql().items()}
