"""Joins with dimension tables: broadcast only behind a count of their rows, and range joins by stretches for any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a dimension table is broadcast.
DIMENSION = 100_000


def dimension(table: DataFrame, rows: int = DIMENSION) -> DataFrame:
    """table, marked for broadcast if it has at most so many rows; a larger one is joined as its size asks for.

    At most one row more than that is counted.
    """
    return F.broadcast(table) if not table.isStreaming and table.limit(rows + 1).count() <= rows else table


def between(rows: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, holds: Column, *, width: float, how: str = "inner") -> DataFrame:
    """rows joined with the ranges for which `holds` is true, a condition that implies low <= at <= high.

    Ranges are cut into stretches of `width`, and a row looks in the stretch it lies in, so stretches are the join's key: no
    side has to fit into memory.  Ranges that end before they begin hold nothing.  Names of the two sides differ.
    """
    stretch = lambda x: F.floor(x / width)
    cut = ranges.where(low <= high).withColumn("__stretch", F.explode(F.sequence(stretch(low), stretch(high))))
    own = rows.withColumn("__place", stretch(at))
    return own.join(cut, (F.col("__place") == F.col("__stretch")) & holds, how).drop("__place", "__stretch")


def last_before(rows: DataFrame, states: DataFrame, keys: tuple[str, ...], at: str, since: str, *, stretches: int = 1024) -> DataFrame:
    """rows with the last state of their keys that began at or before them, if any: columns of states under their names, or null.

    A state holds until the next one of its keys.  Time from the first to the last state is cut into stretches, and a state
    lies in each that it touches (at most the states, and the stretches for each key), so rows of one key, however many,
    are dealt by stretches.  Columns at and since are numbers or instants; rows without a key or a time have no state.
    """
    number = lambda c: F.col(c).cast("double")
    ends = states.agg(F.min(number(since)).alias("__low"), (F.greatest((F.max(number(since)) - F.min(number(since))) / stretches, F.lit(1e-9))).alias("__wide"))  # one row
    place = lambda x: F.least(F.floor((x - F.col("__low")) / F.col("__wide")), F.lit(stretches)).cast("int")
    until = F.lead(since).over(Window.partitionBy(*keys).orderBy(since))
    s = states.where(F.col(since).isNotNull()).withColumn("__until", until).crossJoin(F.broadcast(ends))
    s = s.withColumn("__stretch", F.explode(F.sequence(place(number(since)), F.coalesce(place(number("__until")), F.lit(stretches)))))
    s = s.select(*(F.col(k).alias(f"__{k}") for k in keys), "__until", "__stretch", *(c for c in states.columns if c not in keys))
    own = rows.crossJoin(F.broadcast(ends)).withColumn("__place", place(number(at))).drop("__low", "__wide")
    same = [*(F.col(k) == F.col(f"__{k}") for k in keys), F.col("__place") == F.col("__stretch"), F.col(since) <= F.col(at), F.col("__until").isNull() | (F.col(at) < F.col("__until"))]
    return own.join(s, same, "left").drop("__place", "__stretch", "__until", *(f"__{k}" for k in keys))
