"""Accumulation periods as tumbling windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeline.sources.folders import shared_folder


def tumbling_power(rows: DataFrame, *, period: str = "1 day") -> DataFrame:
    """Samples and power of each station and period of a stream (ts, st, value); reads what there is, then ends.

    Rows count however late they come: the state keeps every period, a row each for a station.  Each micro-batch writes the
    whole result as a table of the shared folder, by its tasks; the last one is returned.
    """
    found = rows.groupBy(F.window("ts", period), "st").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("power"))
    at = f"{shared_folder(rows.sparkSession)}/tumbling-{uuid.uuid4().hex}"
    written: list[int] = []

    def keep(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{at}/{batch}")
        written.append(batch)

    out = found.select(F.col("window.start").alias("start"), "st", "n", "power")
    query = out.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(out.schema).parquet(f"{at}/{written[-1]}") if written else rows.sparkSession.createDataFrame([], out.schema)
