"""Delay and clock polynomials as columns.

Delay sections hold up to six coefficients from their start; every accumulation block gets the polynomial moved
to its start and cut after the square, with the clock in the first two orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeline.operators.joins import between, dimension, last_before

#: Seconds of the stretches by which times look for their section.
STRETCH = 3600.0


def moved(coeffs: Column, d: Column, order: int) -> Column:
    """Coefficient `order` of the polynomial about d: sum over n of C(n, order) c_n d^(n - order)."""
    from math import comb

    out = F.lit(0.0)
    for n in range(5, order - 1, -1):
        c = F.coalesce(F.get(coeffs, F.lit(n)), F.lit(0.0))
        out = out + c * comb(n, order) * F.pow(d, F.lit(n - order))
    return out


def in_sections(rows: DataFrame, sections: DataFrame, how: str = "inner") -> DataFrame:
    """rows (mjd, sec, and station if they have one) with the delay section that holds them, and `into`, the seconds since its start.

    Sections are half-open [start_s, end_s) in seconds from their mjd's midnight on, and may go on over the next one.  Rows
    and sections meet by hours, so neither has to be small.
    """
    s = sections.select(F.col("mjd").alias("s_mjd"), F.col("station").alias("s_station"), *(c for c in sections.columns if c not in ("mjd", "station")))
    at = (F.col("mjd") - F.col("s_mjd")) * 86400 + F.col("sec")
    held = (at >= F.col("start_s")) & (at < F.col("end_s"))
    if "station" in rows.columns:
        held &= F.col("station") == F.col("s_station")
    day = F.col("s_mjd") * 86400.0
    out = between(rows, s, F.col("mjd") * 86400.0 + F.col("sec"), day + F.col("start_s"), day + F.col("end_s"), held, width=STRETCH, how=how)
    if how == "left_anti":
        return out
    out = out.withColumn("into", at - F.col("start_s")).drop("s_mjd")
    return out.drop("s_station") if "station" in rows.columns else out.withColumnRenamed("s_station", "station")


def without_section(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """The rows that no section of their station holds."""
    return in_sections(rows, sections, "left_anti")


def asof(rows: DataFrame, states: DataFrame, keys: tuple[str, ...], at: str, since: str) -> DataFrame:
    """rows with the last state of their keys that began at or before them, if any; neither side has to be small."""
    return last_before(rows, states, keys, at, since)


def block_polynomials(blocks: DataFrame, sections: DataFrame, clocks: DataFrame) -> DataFrame:
    """For each block (block, mjd, sec), source and station: q0, q1, q2 of the delay and k0, k1 of the clock, in seconds.

    Also age, the seconds since the clock's epoch, and model, the name of the section.  A block without a section for a
    station has no row for it.
    """
    found = in_sections(blocks, sections.withColumn("model", F.format_string("%d-%s-%s-so%d-st%d", "mjd", F.col("start_s").cast("string"), F.col("end_s").cast("string"), "source_id", "station")))
    polys = found.select("block", "mjd", "sec", "source_id", "station", "model", *(moved(F.col("coeffs"), F.col("into"), i).alias(f"q{i}") for i in range(3)))
    age = (F.col("mjd") + F.col("sec") / 86400 - F.col("clock_ref")) * 86400
    return polys.join(dimension(clocks.select("station", "clock_ref", "c0", "c1")), "station").select("block", "mjd", "sec", "source_id", "station", "q0", "q1", "q2", (F.col("c0") + F.col("c1") * age).alias("k0"), F.col("c1").alias("k1"), age.alias("age"), "model")


def relative(polys: DataFrame) -> DataFrame:
    """Delays against the station of the largest total delay (the last one of equal ones), signed so they are not negative.

    Adds ref, d0, d1, d2, the reference's root f (the offset at which its total delay equals itself), rel, the delay
    there, the reference's clock z0, z1, and delta, its root against its delay at the start.
    """
    first = Window.partitionBy("block", "source_id").orderBy((F.col("q0") + F.col("k0")).desc(), F.col("station").desc())
    ref = F.struct("station", "q0", "q1", "q2", "k0", "k1")
    r = polys.withColumn("r", F.first(ref).over(first))
    a, slope, c = F.col("r.q2"), F.col("r.q1") + F.col("r.k1") - 1, F.col("r.q0") + F.col("r.k0")
    root = F.when(F.abs(a) < 1e-30, -c / slope).otherwise(2 * c / (-slope + F.sqrt(slope * slope - 4 * a * c)))
    out = r.withColumn("f", root)
    for i, total in enumerate(("q0 - r.q0 + k0 - r.k0", "q1 - r.q1 + k1 - r.k1", "q2 - r.q2")):
        out = out.withColumn(f"d{i}", -F.expr(total) + 0.0)
    return out.withColumn("rel", F.col("d0") + F.col("f") * (F.col("d1") + F.col("f") * F.col("d2"))).withColumns({"ref": F.col("r.station"), "z0": F.col("r.k0"), "z1": F.col("r.k1"), "delta": F.col("f") - F.col("r.q0") - F.col("r.k0")}).drop("r")


def shift_and_fraction(delay: Column, fs: Column, is_complex: Column, *, compat: bool = False) -> tuple[Column, Column]:
    """Whole samples (components, if complex) and the fraction left, in (-0.5, 0.5].

    A carry moves a complex stream by two components; compat moves it by one, as the older behaviour did.
    """
    x = delay * fs
    whole, carry = F.floor(x), x - F.floor(x) > 0.5
    step = F.lit(1) if compat else F.when(is_complex, 2).otherwise(1)
    shift = whole * F.when(is_complex, 2).otherwise(1) + F.when(carry, step).otherwise(0)
    return shift.cast("long"), x - whole - F.when(carry, 1.0).otherwise(0.0)
