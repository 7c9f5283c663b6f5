"""Calibrated scores of several retrieval profiles and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
_BLOCK = ["profile", "low", "high", "weight", "positive"]


def _pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Neighbours whose shares of positives fall are pooled until shares rise: pooling parts first gives the same blocks."""
    out: list[list] = []
    for row in blocks[_BLOCK].itertuples(index=False, name=None):
        out.append(list(row))
        while len(out) > 1 and out[-2][0] == out[-1][0] and out[-2][4] / out[-2][3] > out[-1][4] / out[-1][3] + 1e-15:
            last = out.pop()
            out[-1] = [last[0], out[-1][1], last[2], out[-1][3] + last[3], out[-1][4] + last[4]]
    return pd.DataFrame(out, columns=_BLOCK)


def isotonic_bins(examples: DataFrame) -> DataFrame:
    """``profile, bin, upper, probability, weight, positive``: a rising step function of each profile's score.

    ``examples(profile, score, higher_is_better, relevant, weight)`` are summed by score first.  A step ends halfway between
    its last score and the next one's first; ``upper`` is null for the last.  Scores of profiles where lower is better are
    turned round, and so are the steps' ends.  Ranges of scores are pooled in their own tasks, and what they leave of a
    profile is pooled in one: as many rows as the ranges have steps, not examples.
    """
    oriented = F.when(F.col("higher_is_better"), F.col("score")).otherwise(-F.col("score"))
    points = examples.where("score is not null").groupBy("profile", oriented.alias("low")).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("relevant").cast("double")).alias("positive"))
    points = points.select("profile", "low", F.col("low").alias("high"), F.col("weight").cast("double").alias("weight"), "positive").where("weight > 0")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _pooled(frame)

    kind = examples.schema["profile"].dataType.simpleString()
    schema = f"profile {kind}, low double, high double, weight double, positive double"
    parts = points.repartitionByRange("profile", "low").sortWithinPartitions("profile", "low").mapInPandas(local, schema)
    blocks = parts.groupBy("profile").applyInPandas(lambda f: _pooled(f.sort_values("low")), schema)
    by = Window.partitionBy("profile").orderBy("low")
    return blocks.select(
        "profile", (F.row_number().over(by) - 1).alias("bin"), ((F.col("high") + F.lead("low").over(by)) / 2).alias("upper"),
        (F.col("positive") / F.col("weight")).alias("probability"), "weight", "positive",
    )


def calibrated(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """``scores(profile, higher_is_better, score, ..)`` with the ``probability`` of the bin that a score falls in; bounds belong to the lower bin.

    A profile's bins, as many as its steps, meet its scores as one sorted array, which is halved until one bin is left.  A
    profile without bins is refused.
    """
    steps = bins.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("bin", "upper", "probability"))).alias("_bins"))
    oriented = F.when(F.col("higher_is_better"), F.col("score")).otherwise(-F.col("score"))
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_bins") + F.lit(1))).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at.low + at.high) / 2).cast("int")
        upper = F.get("_bins", middle).upper
        fits = F.coalesce(upper.isNull() | (F.col("_x") <= upper), F.lit(False))
        return F.struct(F.when(fits, at.low).otherwise(middle + 1).alias("low"), F.when(fits, middle).otherwise(at.high).alias("high"))

    first = F.aggregate(halvings, F.struct(F.lit(0).alias("low"), (F.size("_bins") - 1).alias("high")), halve, lambda at: at.low)
    found = F.when(F.col("_bins").isNotNull(), F.get("_bins", first).probability).otherwise(F.raise_error(F.lit("a profile without calibration")).cast("double"))
    return scores.withColumn("_x", oriented).join(steps, "profile", "left").withColumn("probability", found).drop("_bins", "_x")


def fused_profiles(lists: DataFrame, bins: DataFrame | None = None, weights: DataFrame | None = None, k: float = 60.0, top: int = 100) -> DataFrame:
    """``query, item, score, n_profiles, position`` of ``lists(query, profile, item, score, higher_is_better, position)``.

    With ``bins`` an item's score is the weighted mean of its calibrated log-odds, as a probability; without, the sum of
    weight / (k + position).  ``weights(profile, weight)`` default to 1.  Raw scores of profiles are never added up.
    """
    rows = lists if weights is None else lists.join(weights, "profile", "left")
    rows = rows.withColumn("_w", F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0)))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query", "profile", "item").orderBy("position"))).where("_n = 1")
    if bins is None:
        score = F.sum(F.col("_w") / (k + F.col("position")))
    else:
        best = calibrated(best, bins)
        p = F.least(F.greatest("probability", F.lit(EPS)), F.lit(1 - EPS))
        score = 1 / (1 + F.exp(-F.sum(F.col("_w") * F.log(p / (1 - p))) / F.sum("_w")))
    g = best.groupBy("query", "item").agg(score.alias("score"), F.count("*").alias("n_profiles"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item"))).where(F.col("position") <= top)
