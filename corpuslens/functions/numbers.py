"""Column functions over numbers and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (unit, dimension, scale to SI, offset); fixed values.
UNITS = (
    ("mm", "length", 0.001, 0.0), ("cm", "length", 0.01, 0.0), ("m", "length", 1.0, 0.0), ("km", "length", 1000.0, 0.0),
    ("in", "length", 0.0254, 0.0), ("ft", "length", 0.3048, 0.0), ("s", "time", 1.0, 0.0), ("min", "time", 60.0, 0.0),
    ("h", "time", 3600.0, 0.0), ("d", "time", 86400.0, 0.0), ("K", "temperature", 1.0, 0.0),
    ("degC", "temperature", 1.0, 273.15), ("m3/s", "discharge", 1.0, 0.0), ("L/s", "discharge", 0.001, 0.0),
    ("m3", "volume", 1.0, 0.0), ("L", "volume", 0.001, 0.0),
)


def parse_cell(cell: Column) -> Column:
    """Number of a table cell: thousands separators, accounting parentheses, percent as a fraction; else null."""
    t = F.trim(cell)
    negative = t.startswith("(") | t.startswith("-")
    value = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,.]*)", 1), ",", "").try_cast("double")
    value = F.when(t.rlike(r"%\)?$"), value / 100).otherwise(value)
    return F.when(negative, -value).otherwise(value)


def convert(df: DataFrame, value: str, unit: str, target: Column, out: str) -> DataFrame:
    """Adds ``out``: the value in the target unit, null where the dimensions differ or a unit is unknown."""
    units = df.sparkSession.createDataFrame(UNITS, "u string, dimension string, scale double, shift double")
    own = F.broadcast(units.select(F.col("u").alias("_u1"), F.col("dimension").alias("_d1"), F.col("scale").alias("_s1"), F.col("shift").alias("_o1")))
    to = F.broadcast(units.select(F.col("u").alias("_u2"), F.col("dimension").alias("_d2"), F.col("scale").alias("_s2"), F.col("shift").alias("_o2")))
    j = df.withColumn("_target", target).join(own, F.col(unit) == F.col("_u1"), "left").join(to, F.col("_target") == F.col("_u2"), "left")  # the units of UNITS
    si = F.col(value) * F.col("_s1") + F.col("_o1")
    done = j.withColumn(out, F.when(F.col("_d1") == F.col("_d2"), (si - F.col("_o2")) / F.col("_s2")))
    return done.drop("_target", "_u1", "_d1", "_s1", "_o1", "_u2", "_d2", "_s2", "_o2")


def product(df: DataFrame, left: tuple[str, str, str], right: tuple[str, str, str]) -> DataFrame:
    """Adds ``value, dimension, uncertainty``: two quantities (value, unit, uncertainty columns) multiplied in SI units.

    Powers of equal dimensions add up; relative uncertainties add as a root sum of squares; unknown units give null.
    """
    units = df.sparkSession.createDataFrame(UNITS, "u string, dimension string, scale double, shift double")
    for i, (_, unit, _) in enumerate((left, right)):
        side = units.select(F.col("u").alias(f"_u{i}"), F.col("dimension").alias(f"_d{i}"), F.col("scale").alias(f"_s{i}"), F.col("shift").alias(f"_o{i}"))
        df = df.join(F.broadcast(side), F.col(unit) == F.col(f"_u{i}"), "left")  # the units of UNITS
    si = [F.col(v) * F.col(f"_s{i}") + F.col(f"_o{i}") for i, (v, _, _) in enumerate((left, right))]
    error = [F.col(e) * F.col(f"_s{i}") for i, (_, _, e) in enumerate((left, right))]
    first, second = F.least("_d0", "_d1"), F.greatest("_d0", "_d1")
    powers = F.when(F.col("_d0") == F.col("_d1"), F.concat("_d0", F.lit("2"))).otherwise(F.concat(first, F.lit("1 "), second, F.lit("1")))
    spread = F.sqrt(F.pow(error[0] * si[1], 2) + F.pow(error[1] * si[0], 2))
    out = df.withColumn("value", si[0] * si[1]).withColumn("dimension", powers).withColumn("uncertainty", spread)
    return out.drop(*[f"_{c}{i}" for c in "udso" for i in (0, 1)])
