"""Contiguous shards of near-equal size, from global prefix sums.

Rows are ordered by doc_id.  A range of ids has its total of bytes and rows; the running sums of these few totals
give every range its offset, a running sum inside the range gives every row its own, and the bytes before a row
say which of the equal targets it falls into.  Only built-in functions; a range is a partition of about
RANGE_ROWS narrow rows, and is summed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeline.llm.shared import written

#: Rows that a range has about, and ranges at most: their totals are summed in one task and broadcast.
RANGE_ROWS = 100_000
RANGES = 100_000


def shards(docs: DataFrame, *, shards: int = 16, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the text's UTF-8 bytes plus 1 (a null text has none, and the crc32 of an empty one).  The law is `bytes`:
    shards are contiguous in (doc_id, crc32, size) with sizes near equal; a row belongs to the target that holds its
    middle byte.  slot counts from 0 in that order within a shard.  grown_shard is null: another count moves the cuts.
    Null doc_ids come first; equal rows are interchangeable; of long texts only sizes and sums are kept; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ranges = min(RANGES, max(1, -(-rows.count() // range_rows)))
    # written, so that the cuts of the ranges, which Spark samples, are the same in all that follows
    rows = written(rows.repartitionByRange(ranges, "doc_id", "text_crc32", "size").withColumn("range", F.spark_partition_id()), "ranges")
    total = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("count"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = total.select("range", zero(F.sum("bytes").over(before)).alias("bytes_before"), zero(F.sum("count").over(before)).alias("rows_before"), F.sum("bytes").over(all_).alias("all_bytes"))
    inside = Window.partitionBy("range").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("start", zero(F.sum("size").over(inside))).withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "text_crc32", "size")) - 1).join(F.broadcast(offsets), "range")
    middle = F.col("bytes_before") + F.col("start") + F.expr("size div 2")
    placed = joined.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.col("all_bytes")).cast("int")).alias("shard"), (F.col("rows_before") + F.col("nth")).alias("row"), "range")
    # the first row of a shard is the least of its ranges' first rows
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
