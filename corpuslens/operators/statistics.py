"""Calibration, drift, tests and summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliability_bins(rows: DataFrame, bins: int = 10, conf: str = "conf", y: str = "y", w: str = "w", by: tuple[str, ...] = ()) -> DataFrame:
    """``bin, weight, confidence, accuracy, gap`` of equal-width bins."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    g = rows.groupBy(*by, b.alias("bin")).agg(F.sum(w).alias("weight"), F.sum(F.col(w) * F.col(conf)).alias("c"), F.sum(F.col(w) * F.col(y)).alias("a"))
    g = g.withColumn("confidence", F.col("c") / F.col("weight")).withColumn("accuracy", F.col("a") / F.col("weight"))
    return g.withColumn("gap", F.col("accuracy") - F.col("confidence")).drop("c", "a")


def calibration_error(bins: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    gap = F.abs("gap")
    return bins.groupBy(*by).agg((F.sum(F.col("weight") * gap) / F.sum("weight")).alias("ece"), F.max(gap).alias("mce"))


def brier(conf: Column, y: Column, w: Column) -> Column:
    return F.sum(w * F.pow(conf - y, 2)) / F.sum(w)


def log_loss(conf: Column, y: Column, eps: float = 1e-12) -> Column:
    p = F.least(F.greatest(conf, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def risk_coverage(rows: DataFrame, conf: str = "conf", y: str = "y", digits: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage and risk when answering from each confidence up: ``threshold, coverage, risk``.

    Confidences are rounded to ``digits`` and summed first, so the ordered table has 10^digits + 1 rows a group at most.
    """
    steps = rows.groupBy(*by, F.round(conf, digits).alias("threshold")).agg(F.count("*").alias("n"), F.sum(1 - F.col(y)).alias("wrong"))
    down = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    every = Window.partitionBy(*by)
    return steps.select(
        *by, "threshold", (F.sum("n").over(down) / F.sum("n").over(every)).alias("coverage"), (F.sum("wrong").over(down) / F.sum("n").over(down)).alias("risk"),
        F.sum("n").over(down).alias("answered"), F.sum("wrong").over(down).alias("wrong"), F.sum("n").over(every).alias("total"),
    )


def histogram(rows: DataFrame, value: str, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``bin, n, share`` of half-open bins, the last one closed; values outside are left out."""
    v = F.col(value)
    b = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (v >= lo) & ((v < hi) if i < len(edges) - 2 else (v <= hi))
        b = F.when(inside, i).otherwise(b)
    g = rows.select(*by, b.alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def stability_index(ref: Column, cur: Column, floor: float = 1e-6) -> Column:
    r, c = F.greatest(ref, F.lit(floor)), F.greatest(cur, F.lit(floor))
    return F.sum((c - r) * F.log(c / r))


def js_divergence(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return F.sum((part(p) + part(q)) / 2)


def holm(tests: DataFrame, by: tuple[str, ...] = (), p: str = "p", key: str = "test") -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - i) p."""
    up = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = tests.withColumn("_raw", F.least(F.lit(1.0), (m - F.row_number().over(up) + 1) * F.col(p)))
    return raw.withColumn("adjusted", F.max("_raw").over(up)).drop("_raw")


def benjamini_hochberg(tests: DataFrame, by: tuple[str, ...] = (), p: str = "p", key: str = "test") -> DataFrame:
    """Step-up adjusted p-values: running minimum of p m / rank from the largest."""
    up = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = tests.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * m / F.row_number().over(up)))
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(key))
    return raw.withColumn("adjusted", F.min("_raw").over(down)).drop("_raw")


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    rate = wins / n
    centre = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def meta_analysis(studies: DataFrame, by: tuple[str, ...] = (), effect: str = "effect", variance: str = "variance") -> DataFrame:
    """Inverse-variance pooling: ``k, fixed, q, i2, tau2, random, random_se`` (DerSimonian-Laird)."""
    w = 1 / F.col(variance)
    g = studies.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col(effect)).alias("swy"), F.sum(w * F.col(effect) * F.col(effect)).alias("swyy")
    )
    g = g.withColumn("fixed", F.col("swy") / F.col("sw")).withColumn("q", F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    g = g.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / F.col("q"))).otherwise(0.0))
    g = g.withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / c)).otherwise(0.0))
    join = studies.join(g.select(*by, "tau2"), list(by)) if by else studies.crossJoin(F.broadcast(g.select("tau2")))  # one row
    wr = 1 / (F.col(variance) + F.col("tau2"))
    r = join.groupBy(*by).agg((F.sum(wr * F.col(effect)) / F.sum(wr)).alias("random"), F.sqrt(1 / F.sum(wr)).alias("random_se"))
    cols = [*by, "k", "fixed", "q", "i2", "tau2"]
    return g.select(*cols).join(r, list(by)) if by else g.select(*cols).crossJoin(F.broadcast(r))  # one row


def isotonic(rows: DataFrame, by: str, conf: str = "conf", y: str = "y", digits: int = 3) -> DataFrame:
    """Pool-adjacent-violators steps of each group: ``by, lo, hi, value``.

    Confidences are rounded and summed by Spark first: 10^digits + 1 points a group at most reach its task.
    """
    points = rows.groupBy(by, F.round(conf, digits).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for x, n, s in pdf.sort_values("x")[["x", "n", "s"]].itertuples(index=False):
            blocks.append([x, x, n, s])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                lo, _, n1, s1 = blocks[-2]
                _, hi, n2, s2 = blocks[-1]
                blocks[-2:] = [[lo, hi, n1 + n2, s1 + s2]]
        out = pd.DataFrame([(b[0], b[1], b[3] / b[2]) for b in blocks], columns=["lo", "hi", "value"])
        out.insert(0, by, pdf[by].iloc[0])
        return out

    kind = dict(rows.dtypes)[by]
    return points.groupBy(by).applyInPandas(fit, f"{by} {kind}, lo double, hi double, value double")


def paired_resamples(pairs: DataFrame, resamples: int = 200, seed: int = 7) -> DataFrame:
    """``sample, mean_difference`` of bootstrap resamples of ``pairs(id, difference)`` by Poisson weights.

    Each pair's weight in a resample comes from a hash of (seed, resample, id), so reruns agree; weights are summed
    before the shuffle and only ``resamples`` rows come out.
    """
    samples = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("sample")
    each = pairs.select("id", "difference", samples)
    u = F.pmod(F.xxhash64(F.lit(seed), "sample", "id"), F.lit(1 << 40)) / float(1 << 40)
    cum, weight = 0.0, F.lit(8)
    steps = []
    for k in range(8):
        cum += math.exp(-1) / math.factorial(k)
        steps.append((k, cum))
    for k, c in reversed(steps):
        weight = F.when(u < c, k).otherwise(weight)
    each = each.withColumn("w", weight)
    return each.groupBy("sample").agg((F.sum(F.col("w") * F.col("difference")) / F.sum("w")).alias("mean_difference"))


def sign_flips(pairs: DataFrame, flips: int = 200, seed: int = 11) -> DataFrame:
    """One row: ``mean_difference, p_value`` of a sign-flip test with hash-drawn signs."""
    draws = F.explode(F.sequence(F.lit(0), F.lit(flips - 1))).alias("flip")
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "flip", "id"), F.lit(2)) == 0, 1).otherwise(-1)
    nulls = pairs.select("id", "difference", draws).groupBy("flip").agg(F.avg(sign * F.col("difference")).alias("m"))
    mean = pairs.agg(F.avg("difference").alias("mean_difference"))
    return nulls.crossJoin(F.broadcast(mean)).groupBy("mean_difference").agg(  # one row
        ((F.sum((F.abs("m") >= F.abs("mean_difference")).cast("int")) + 1) / F.lit(flips + 1.0)).alias("p_value")
    )


def softmax_fit(rows: DataFrame, features: list[str], y: str, rounds: int = 60, rate: float = 1.0) -> np.ndarray:
    """Logistic weights by gradient ascent: each round is one aggregate over all rows; only sums reach the driver."""
    theta = np.zeros(len(features) + 1)
    for _ in range(rounds):
        z = F.lit(float(theta[0]))
        for t, f in zip(theta[1:], features, strict=True):
            z = z + float(t) * F.col(f)
        err = F.col(y) - 1 / (1 + F.exp(-z))
        g = rows.agg(F.avg(err), *[F.avg(err * F.col(f)) for f in features]).first()
        theta = theta + rate * np.array([x or 0.0 for x in g])
    return theta
