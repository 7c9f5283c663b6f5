"""Time series by key: integrals, peaks and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def integral(points: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """Trapezoid integral of each series: ``key, volume``."""
    w = Window.partitionBy(key).orderBy(t)
    step = (F.col(v) + F.lag(v).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    return points.withColumn("_part", step).groupBy(key).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("volume"))


def peaks(points: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """``key, peak, peak_time``: the first of the largest values."""
    best = F.max(F.struct(F.col(v).alias("v"), (-F.col(t)).alias("t")))
    return points.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.v").alias("peak"), (-F.col("_b.t")).alias("peak_time"))


def neighbours_ordered(points: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Rows whose value does not fall from the row before: an issue for each."""
    w = Window.partitionBy(*keys).orderBy(place)
    return points.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col(value) >= F.col("before")))


def compared_hydrographs(baseline: DataFrame, candidate: DataFrame, key: list[str], t: str, v: str) -> DataFrame:
    """``key, peak_delta, peak_time_delta, volume_delta`` of series that both sides have; volumes by the trapezium rule."""

    def summary(points: DataFrame, p: str) -> DataFrame:
        one = points.withColumn("_k", F.struct(*key))
        both = peaks(one, "_k", t, v).join(integral(one, "_k", t, v), "_k")
        return both.select("_k", *[F.col(c).alias(p + c) for c in ("peak", "peak_time", "volume")])

    j = summary(baseline, "a_").join(summary(candidate, "b_"), "_k")
    return j.select("_k.*", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_delta") for c in ("peak", "peak_time", "volume")])
