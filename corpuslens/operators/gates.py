"""Gates on learned fusion weights and on paired runs of a current and a shadow system."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
Z95 = 1.96


def _logit(p: Column) -> Column:
    """Log-odds; null stays null."""
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))


def fused_probability(weights: dict[str, float]) -> Column:
    """The probability of the weighted log-odds of columns."""
    score = reduce(lambda a, b: a + b, [F.lit(float(w)) * _logit(F.col(c)) for c, w in weights.items()])
    return 1 / (1 + F.exp(-score))


def _reasons(checks: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()])))


def qualify_fusion(
    rows: DataFrame, weights: dict[str, float], relevant: str, weight: str | None = None, min_rows: int = 100, min_positive: int = 10, min_negative: int = 10, max_loss: float = 0.7,
    max_brier: float = 0.25, min_loss_gain: float = 0.0, min_brier_gain: float = 0.0, max_weight: float = 0.95,
) -> DataFrame:
    """One row: losses and Brier scores of the learned and of equal weights on held-out rows, ``eligible`` and ``reasons``.

    Rows of a profile without probability are refused by their null: losses would be null, and every gate on a null fails.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    y = F.col(relevant).cast("double")
    rows = rows.withColumn("_l", fused_probability(weights)).withColumn("_u", fused_probability(dict.fromkeys(weights, 1 / len(weights))))

    def mean(x: Column) -> Column:
        return F.when(F.count(x) == F.count("*"), F.sum(w * x) / F.sum(w))

    def loss(p: str) -> Column:
        q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
        return mean(F.when(F.col(p).isNotNull(), -(y * F.log(q) + (1 - y) * F.log(1 - q))))

    brier = lambda p: mean(F.pow(F.col(p) - y, 2))
    g = rows.agg(
        F.count("*").alias("n"), F.count(F.when(y == 1, 1)).alias("n_positive"), loss("_l").alias("learned_loss"), loss("_u").alias("uniform_loss"), brier("_l").alias("learned_brier"), brier("_u").alias("uniform_brier")
    )
    c = F.col
    checks = {
        "insufficient_evaluation_examples": c("n") < min_rows, "insufficient_positive_examples": c("n_positive") < min_positive, "insufficient_negative_examples": c("n") - c("n_positive") < min_negative,
        "log_loss_threshold_exceeded": c("learned_loss") > max_loss, "brier_threshold_exceeded": c("learned_brier") > max_brier,
        "insufficient_log_loss_improvement": c("uniform_loss") - c("learned_loss") < min_loss_gain, "insufficient_brier_improvement": c("uniform_brier") - c("learned_brier") < min_brier_gain,
        "profile_weight_collapse": F.lit(max(weights.values()) > max_weight),
    }
    return g.withColumn("reasons", _reasons(checks)).withColumn("eligible", F.size("reasons") == 0)


def _ndcg(rows: DataFrame, score: Column, grade: str, k: int, name: str) -> DataFrame:
    """``query, name``: NDCG at k with gains 2^grade - 1; equal scores go by item."""
    by = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    placed = rows.withColumn("_s", score).withColumn("_n", by(F.desc(F.round("_s", 9)), "item")).withColumn("_i", by(F.desc(grade), "item"))
    gain = lambda n: F.sum(F.when(F.col(n) <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(n) + 1)).otherwise(0.0))
    g = placed.groupBy("query").agg(gain("_n").alias("d"), gain("_i").alias("i"))
    return g.select("query", F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0).alias(name))


def qualify_listwise(
    rows: DataFrame, weights: dict[str, float], grade: str, k: int = 10, min_queries: int = 20, min_gain: float = 0.0, max_regressed: float = 0.2, max_weight: float = 0.95,
) -> DataFrame:
    """One row: mean NDCG of learned and equal weights over ``rows(query, item, <profiles>)``, the share of queries that lose, ``eligible``, ``reasons``."""
    score = lambda w: reduce(lambda a, b: a + b, [F.lit(float(v)) * _logit(F.col(p)) for p, v in w.items()])
    learned, uniform = _ndcg(rows, score(weights), grade, k, "learned"), _ndcg(rows, score(dict.fromkeys(weights, 1 / len(weights))), grade, k, "uniform")
    g = learned.join(uniform, "query").agg(
        F.count("*").alias("n_queries"), F.avg("learned").alias("learned_ndcg"), F.avg("uniform").alias("uniform_ndcg"), F.avg((F.col("learned") < F.col("uniform") - 1e-9).cast("double")).alias("regressed")
    )
    c = F.col
    checks = {
        "insufficient_queries": c("n_queries") < min_queries, "insufficient_ndcg_gain": c("learned_ndcg") - c("uniform_ndcg") < min_gain, "too_many_regressed_queries": c("regressed") > max_regressed,
        "profile_weight_collapse": F.lit(max(weights.values()) > max_weight),
    }
    return g.withColumn("reasons", _reasons(checks)).withColumn("eligible", F.size("reasons") == 0)


def paired_benchmark(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, current, shadow, delta, low, high, n_seeds`` of ``runs(seed, side, <metrics>)``: rates by seed, then their mean difference.

    The interval is 1.96 standard errors of the differences of seeds; with one seed it has no width.  A seed that only one
    side ran is left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    rates = runs.select("seed", "side", each.alias("m")).groupBy("seed", "m.metric").agg(*[F.avg(F.when(F.col("side") == s, F.col("m.value"))).alias(s) for s in ("current", "shadow")])
    d = rates.where("current is not null and shadow is not null").withColumn("d", F.col("shadow") - F.col("current"))
    g = d.groupBy("metric").agg(F.avg("current").alias("current"), F.avg("shadow").alias("shadow"), F.avg("d").alias("delta"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("_s"), F.count("*").alias("n_seeds"))
    half = Z95 * F.col("_s") / F.sqrt("n_seeds")
    return g.select("metric", "current", "shadow", "delta", (F.col("delta") - half).alias("low"), (F.col("delta") + half).alias("high"), "n_seeds")


def statistical_gate(benchmark: DataFrame, margins: dict[str, float], gains: dict[str, float], min_seeds: int = 3) -> DataFrame:
    """``metric, noninferior, practical, decision, reasons`` over ``paired_benchmark``: one failing metric or too few seeds block all.

    A metric passes if its lower bound stays above the negative margin and, where ``gains`` names it, reaches the gain.  A
    metric without margin is refused.
    """
    of = lambda d, c: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[c] if d else F.lit(None).cast("double")
    margin = of(margins, F.col("metric"))
    margin = F.when(margin.isNull(), F.raise_error(F.lit("a metric without margin")).cast("double")).otherwise(margin)
    rows = benchmark.withColumn("noninferior", F.col("low") >= -margin).withColumn("practical", F.col("low") >= of(gains, F.col("metric")))
    own = F.array_compact(F.array(
        F.when(~F.col("noninferior"), F.concat(F.lit("paired_"), "metric", F.lit("_noninferiority_failed"))), F.when(F.col("practical") == F.lit(False), F.concat(F.lit("paired_"), "metric", F.lit("_practical_gain_failed"))),
        F.when(F.col("n_seeds") < min_seeds, F.lit("paired_seed_count_below_minimum")),
    ))
    all_ = Window.partitionBy()  # as many rows as metrics
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_list(own).over(all_))))
    rows = rows.withColumn("reasons", reasons)
    return rows.select("metric", "noninferior", "practical", F.when(F.size("reasons") > 0, "blocked").otherwise("passed").alias("decision"), "reasons")
