"""Tables that cut lineage, in the folder that all executors share, and columns by their exact names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
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


#: Frees a run's shuffle files at its end; once a table is written, nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    What is left of these tables when the driver ends is removed then; discard() removes one before.  The setting that
    frees shuffle files holds for the session while the table is written; it changes when files go, not results.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_sweep)
    _left.append((spark, path))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(table: DataFrame) -> None:
    """Removes the files of a table of written() that nothing reads any more."""
    path = getattr(table, "_written_path", None)
    if path:
        _remove(table.sparkSession, path)
        _left[:] = [x for x in _left if x[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _left:
        with contextlib.suppress(Exception):  # the session may be over
            _remove(spark, path)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def whole(docs: DataFrame) -> Column:
    """The row as one struct, so that working columns beside it can have any name."""
    return F.struct(*(named(c).alias(c) for c in docs.columns))


def opened(rows: DataFrame, columns: list[str], row: str = "row", **new: Column) -> DataFrame:
    """The columns of a row of whole(), some of them replaced."""
    return rows.select(*(new.get(c, F.col(row).getField(c)).alias(c) for c in columns))


def safe(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1 and so on: mapInArrow takes no names with dots."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, column: str) -> str:
    """The name that safe() gives a column."""
    return f"c{docs.columns.index(column)}"


def fresh(docs: DataFrame, name: str) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where the table has fewer splits than there are cores; larger tables stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows
