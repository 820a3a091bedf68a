"""Importance resampling towards a target distribution, over hashed word n-grams.

A position table holds a row for each word; lead() over a document's positions puts the words that follow beside it, so
a row spells the n-gram of each order that starts there.  N-grams are hashed into buckets; buckets of the documents and
of the target are counted, their gains (log ratios) joined back, and a document's weight is the mean over its n-grams.
The draw is a Gumbel top-k: a hash of doc_id gives the noise, and the highest scores get their ranks from the totals of
score ranges.  All of it is built-in functions.  Only counts of buckets are broadcast, a table whose size is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeline.llm.shared import discard, fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text whose A-Z are not yet lower-cased: letters and digits of ASCII, and all beyond it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Buckets up to which their gains are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST = 1 << 20
#: Rows that a range of scores has about, and ranges at most.
RANGE_ROWS, RANGES = 100_000, 100_000


def lowered(text: Column) -> Column:
    """A-Z become a-z; where a text is ASCII, that is what lower() does."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def buckets_of(texts: DataFrame, keys: list[str], *, orders: int, buckets: int) -> DataFrame:
    """keys, and buckets b1, b2 and so on of the n-grams that start at each word; null where the document ends before.

    keys name a document; a text without words has one row of nulls.
    """
    words = texts.select(*keys, F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    words = words.withColumn("word", lowered(F.col("word")))
    ahead = Window.partitionBy(*keys).orderBy("pos")
    table = words.select(*keys, "word", *(F.lead("word", k).over(ahead).alias(f"w{k}") for k in range(1, orders)))
    grams = [F.col("word")]
    for k in range(1, orders):
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"w{k}")))  # null beyond the end
    return table.select(*keys, *((F.crc32(g) % buckets).cast("int").alias(f"b{k}") for k, g in enumerate(grams, 1)))


def counts(table: DataFrame, orders: int) -> DataFrame:
    """bucket and n of each bucket that has an n-gram."""
    each = table.select(F.explode(F.array(*(f"b{k}" for k in range(1, orders + 1)))).alias("bucket")).where("bucket IS NOT NULL")
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket that the corpus has."""
    total = lambda c: c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    rows = corpus.join(target.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(F.broadcast(total(corpus).withColumnRenamed("all", "s_all"))).crossJoin(F.broadcast(total(target).withColumnRenamed("all", "t_all")))
    double = lambda c, more: F.coalesce(F.col(c), F.lit(0)).cast("double") + more
    ratio = double("t", 1) * double("s_all", buckets) / (double("n", 1) * double("t_all", buckets))
    return rows.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in thousandths: a hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with their place in an order, from 1; a range of rows counts by itself, after the totals of those before."""
    n = rows.count()
    ranges = min(RANGES, max(1, -(-n // range_rows)))
    part = fresh(rows, "part")
    # written, so that the cuts of the ranges, which Spark samples, are the same in all that follows
    rows = written(rows.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), "ranked")
    size = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = size.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return rows.withColumn(name, own).join(F.broadcast(before), part).withColumn(name, (F.col(name) + F.col("before")).cast("long")).drop(part, "before")


def numbered(texts: DataFrame, *names: str) -> DataFrame:
    """names, h, copy and text: rows of the same names and text have one hash h and different numbers.

    Its exchange by names and h, and its order, serve the window over the words too.
    """
    rows = texts.withColumn("h", F.xxhash64("text"))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*names, "h").orderBy("text")))


def resampled(docs: DataFrame, target: DataFrame, *, orders: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20, percent: int = 25, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    target is a table with a column text.  Null and empty texts have no n-grams and weight 0, and count for nothing in the
    target; whole texts of any length are counted, positions of one that exceeds memory spill.  A null doc_id is hashed as
    an empty one and comes last among equals.  Rows that repeat doc_id and text are told apart by their number, and each
    is drawn by itself; ties are ordered by doc_id, then by n_features and weight, and what is equal in all is
    interchangeable.  Other columns are ignored whatever their names.  Empty documents give no rows; an empty target
    gives gains by the documents' own counts.
    """
    text = F.col("text").cast("string").alias("text")
    keys, grams = ["doc_id", "h", "copy"], [f"b{k}" for k in range(1, orders + 1)]
    table = written(buckets_of(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), "doc_id"), keys, orders=orders, buckets=buckets), "positions")
    aim = counts(buckets_of(numbered(target.select(text)), ["h", "copy"], orders=orders, buckets=buckets), orders)
    own, aim = written(counts(table, orders), "corpus"), written(aim, "target")
    gain = written(gains(own, aim, buckets), "gains")
    rows, sums = table, []
    for b in grams:
        of = gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"gain_{b}"))
        rows = rows.join(F.broadcast(of) if buckets <= BROADCAST else of, b, "left")
        sums.append(F.coalesce(F.col(f"gain_{b}"), F.lit(0)))
    count = lambda c: F.count(c)
    scored = rows.groupBy(*keys).agg(count("b1").alias("n_words"), sum((count(b) for b in grams[1:]), count("b1")).alias("n_features"), F.sum(sum(sums[1:], sums[0])).alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = scored.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    scored = written(scored, "scored")
    for t in (table, own, aim, gain):
        discard(t)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    placed = ranked(able, order, "rank", range_rows=range_rows).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select("doc_id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", "rank")
