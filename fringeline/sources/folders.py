"""The folder that driver and executors share, and a sink of files whose rows are bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where that is unset and there is one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="fringeline-"))
    return _own[0]


def local_path(path: str) -> str:
    """The path of a file that this machine sees, without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


class Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class FilesWriter(DataSourceWriter):
    """Rows (file, body) appended to files of these names in the folder `path`, which all executors see.

    A task writes to files of its own, which get their names once all tasks are done, so tasks can be run again.
    """

    def __init__(self, options: dict[str, str]):
        self.folder = local_path(options["path"])
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        names: dict[str, str] = {}
        handle, name = None, None
        for r in rows:
            if r[0] != name:
                if handle:
                    handle.close()
                name = r[0]
                names.setdefault(name, f"{self.folder}/.{uuid.uuid4().hex}")
                handle = open(names[name], "ab")  # noqa: SIM115
            handle.write(bytes(r[1]))
        if handle:
            handle.close()
        return Written(list(names.items()))

    def commit(self, messages: list[Written | None]) -> None:
        done = [x for m in messages if m for x in m.names]
        if len({name for name, _ in done}) < len(done):
            raise ValueError("a file's rows must be in one partition")
        for name, own in done:
            os.replace(own, f"{self.folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for _, own in m.names if m else ():
                if os.path.exists(own):
                    os.remove(own)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, body binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def write_files(rows: DataFrame, path: str) -> None:
    """Writes rows (file, body) into files of the folder; a file's rows must lie in one partition, in order."""
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select(F.col("file").cast("string"), F.col("body").cast("binary")).write.format("named_files").mode("append").save(path)


def write_parts(rows: DataFrame, order: list, path: str, *, parts: int | None = None) -> None:
    """Writes bodies in order as files part-00000 and on, whose bytes end to end are the whole."""
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    write_files(ordered.select(F.format_string("part-%05d", F.spark_partition_id()).alias("file"), "body"), path)


#: Bytes that a task copies at once.
PIECE = 64 << 20


def merged(spark: SparkSession, folder: str, file: str, *, piece: int = PIECE) -> None:
    """Writes the files of a folder, end to end in the order of their names, as one file that all executors see.

    The sizes of the parts before it are a part's place in the file, so each task writes its own stretch, and again the
    same bytes if it is run again; the file gets its name once all are there.
    """
    source, target = local_path(folder), local_path(file)
    rows, at = [], 0
    for name in sorted(f for f in os.listdir(source) if not f.startswith((".", "_"))):
        size = os.path.getsize(f"{source}/{name}")
        rows += [(f"{source}/{name}", i, min(piece, size - i), at + i) for i in range(0, size, piece)]
        at += size
    own = f"{target}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, start, size, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(path, "rb") as f, open(own, "r+b") as g:
                    f.seek(start)
                    g.seek(place)
                    while size > 0 and (raw := f.read(min(size, 4 << 20))):
                        g.write(raw)
                        size -= len(raw)
                done.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["left"])

    if rows:
        pieces = spark.createDataFrame(rows, "path string, start long, size long, place long").repartition(len(rows))
        if pieces.mapInArrow(copy, "left long").where("left <> 0").count():
            raise OSError(f"{folder}: a file has become shorter")
    os.replace(own, target)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
