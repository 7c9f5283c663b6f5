"""Journal of interleaved result lists: impressions meet their outcomes, in batch or as two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.statistics import wilson


def _once(rows: DataFrame, key: str, content: Column, lateness: str) -> DataFrame:
    """Each content of a key once; a repeated report is no second one."""
    marked = rows.withColumn("_content", content)
    if rows.isStreaming:
        return marked.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key, "_content"])
    return marked.dropDuplicates([key, "_content"])


def complete_impressions(impressions: DataFrame, outcomes: DataFrame, within: str, lateness: str = "1 hour") -> DataFrame:
    """``experiment, impression, query, shown_at, engaged_at, preference`` of each impression that has an outcome in time.

    ``impressions(experiment, impression, query, sides, ts)`` names the side (a or b) that gave each position;
    ``outcomes(experiment, impression, engaged, ts)`` the positions used, from 0.  An outcome counts if it names the same
    experiment and comes up to ``within`` after the impression.  Preference is 1 for a, -1 for b, 0 for neither.  A
    position outside the list is refused.  On streams both sides carry watermarks of ``lateness``, so that an impression is
    kept for ``within`` and ``lateness`` at most.
    """
    i = _once(impressions, "impression", F.xxhash64("experiment", "query", F.array_join("sides", ",")), lateness)
    o = _once(outcomes, "impression", F.xxhash64("experiment", F.array_join(F.transform("engaged", lambda p: p.cast("string")), ",")), lateness)
    i = i.select("experiment", "impression", "query", "sides", F.col("ts").alias("shown_at"), F.col("_content").alias("shown"))
    o = o.select(F.col("experiment").alias("of"), F.col("impression").alias("seen"), "engaged", F.col("ts").alias("engaged_at"), F.col("_content").alias("outcome"))
    timely = (F.col("engaged_at") >= F.col("shown_at")) & (F.col("engaged_at") <= F.col("shown_at") + F.expr(f"interval {within}"))
    pairs = i.join(o, (F.col("impression") == F.col("seen")) & (F.col("experiment") == F.col("of")) & timely)
    outside = F.exists("engaged", lambda p: (p < 0) | (p >= F.size("sides")))
    credit = lambda side: F.size(F.filter("engaged", lambda p: F.get("sides", p) == side))
    preference = F.when(outside, F.raise_error(F.lit("outcome names a position that was not shown")).cast("int")).otherwise(F.signum(credit("a") - credit("b")).cast("int"))
    return pairs.select("experiment", "impression", "query", "shown_at", "engaged_at", preference.alias("preference"), "shown", "outcome")


def export(complete: DataFrame) -> DataFrame:
    """``complete`` with one row an impression; an impression shown or answered in two ways is refused."""
    both = complete.groupBy("impression").agg(F.count_distinct("shown").alias("a"), F.count_distinct("outcome").alias("b"), F.first(F.struct(*complete.columns)).alias("row"))
    one = F.when((F.col("a") > 1) | (F.col("b") > 1), F.raise_error(F.lit("impression identity collision"))).otherwise(F.col("row.experiment"))
    return both.select(one.alias("experiment"), *[F.col(f"row.{c}").alias(c) for c in ("impression", "query", "shown_at", "engaged_at", "preference")])


def experiment_results(complete: DataFrame) -> DataFrame:
    """``experiment, impressions, wins_a, wins_b, ties, rate, low, high``: the preference for a with its Wilson interval."""
    n = lambda v, name: F.count(F.when(F.col("preference") == v, 1)).alias(name)
    g = complete.groupBy("experiment").agg(F.count("*").alias("impressions"), n(1, "wins_a"), n(-1, "wins_b"), n(0, "ties"))
    decisive = F.col("wins_a") + F.col("wins_b")
    low, high = wilson(F.col("wins_a"), decisive)
    either = lambda value, none: F.when(decisive > 0, value).otherwise(F.lit(none))
    return g.select("*", either(F.col("wins_a") / decisive, 0.5).alias("rate"), either(low, 0.0).alias("low"), either(high, 1.0).alias("high"))
