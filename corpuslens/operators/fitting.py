"""Fits by gradient descent in which every epoch is one aggregate over a table; only sums reach the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


@dataclass(frozen=True)
class Settings:
    """``patience`` epochs without a gain of ``min_delta`` on the held rows end a fit; ``clip`` bounds a gradient's norm."""

    epochs: int = 100
    rate: float = 0.05
    l2: float = 1e-4
    clip: float | None = 5.0
    patience: int = 10
    min_delta: float = 1e-5
    centred: bool = False


@dataclass
class Fit:
    theta: np.ndarray
    best_epoch: int
    best_loss: float
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @property
    def weights(self) -> np.ndarray:
        """The softmax of ``theta``: non-negative weights that sum to one."""
        return softmax(self.theta)


def softmax(theta: np.ndarray) -> np.ndarray:
    e = np.exp(theta - theta.max())
    return e / e.sum()


def descend(rows: DataFrame, objective: Callable[[DataFrame, np.ndarray], tuple[DataFrame, Column, list[Column]]], start: np.ndarray, settings: Settings, held: str = "held", weight: str | None = None) -> Fit:
    """Full-batch descent with early stop on the rows with ``held`` (on the others where there are none).

    ``objective(rows, theta)`` gives the rows with what it works out first, a row's loss and its gradient.  One pass at a theta takes the gradient of the rows to learn
    from and the loss of both parts, so an epoch costs one scan and shuffles two rows a task.  Rows should be a written
    table of the columns that the objective needs.  The theta of the epoch with the lowest loss is returned; epochs count
    from 1.  A table without rows to learn from is refused.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    theta, best, stale, history = np.array(start, float), None, 0, []
    for epoch in range(settings.epochs + 1):
        worked, loss, gradient = objective(rows, theta)
        sums = worked.groupBy(F.col(held).alias("held")).agg(F.sum(w).alias("w"), F.sum(w * loss).alias("loss"), *[F.sum(w * g).alias(f"g{i}") for i, g in enumerate(gradient)])
        parts = {r.held: r for r in sums.collect()}
        if False not in parts:
            raise ValueError("there are no rows to learn from")
        learn, judge = parts[False], parts.get(True, parts[False])
        penalty = 0.0 if settings.centred else 0.5 * settings.l2 * float(theta @ theta)
        if epoch:
            now = judge.loss / judge.w + penalty
            history.append((epoch, learn.loss / learn.w + penalty, now))
            if best is None or now < best[1] - settings.min_delta:
                best, stale = (epoch, now, theta.copy()), 0
            else:
                stale += 1
            if stale >= settings.patience or epoch == settings.epochs:
                break
        step = np.array([learn[f"g{i}"] for i in range(len(theta))]) / learn.w + settings.l2 * theta
        norm = float(np.linalg.norm(step))
        if settings.clip and norm > settings.clip:
            step *= settings.clip / norm
        theta = theta - settings.rate * step
        if settings.centred:
            theta = theta - theta.mean()
    return Fit(best[2], best[0], best[1], history)


def logit(p: Column) -> Column:
    """Log-odds of a probability; a missing one is refused."""
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.when(p.isNull(), F.raise_error(F.lit("a probability is missing")).cast("double")).otherwise(F.log(q / (1 - q)))


def _dot(weights: np.ndarray, features: Column) -> Column:
    return sum((F.lit(float(w)) * features[i] for i, w in enumerate(weights)), F.lit(0.0))


def fusion_fit(rows: DataFrame, profiles: list[str], relevant: str, settings: Settings = Settings(centred=True), held: str = "held", weight: str | None = None) -> Fit:
    """Weights of the profiles' calibrated probabilities in log-odds, fitted to ``relevant`` by cross-entropy.

    Weights are a softmax of theta, so they are non-negative and sum to one.
    """

    def objective(rows, theta):
        w = softmax(theta)
        f = [logit(F.col(p)) for p in profiles]
        rows = rows.withColumn("_score", sum((float(a) * x for a, x in zip(w, f)), F.lit(0.0)))
        score, y = F.col("_score"), F.col(relevant).cast("double")
        p = 1 / (1 + F.exp(-score))
        clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
        return rows, -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped)), [(p - y) * float(a) * (x - score) for a, x in zip(w, f)]

    return descend(rows, objective, np.zeros(len(profiles)), settings, held, weight)


def ranking_lists(rows: DataFrame, profiles: list[str], grade: str, query: str = "query_id", held: str = "held", temperature: float = 1.0) -> DataFrame:
    """``query, held, candidates``: one row a query with the log-odds of its candidates and their target shares.

    The shares are a softmax of the grades.  A query's candidates are those that searches returned for it; queries with
    one candidate or one grade teach nothing and are left out.  Lists are gathered once, so that epochs don't shuffle.
    """
    each = F.struct(F.array(*[logit(F.col(p)) for p in profiles]).alias("f"), (F.col(grade) / temperature).alias("g"))
    lists = rows.groupBy(query).agg(F.max(held).alias("held"), F.collect_list(each).alias("c"), F.count_distinct(grade).alias("grades")).where("grades > 1")
    top = F.array_max(F.transform("c", lambda x: x.g))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.exp(x.g - F.col("top")))
    lists = lists.withColumn("top", top).withColumn("total", total)
    return lists.select(query, "held", F.transform("c", lambda x: F.struct(x.f.alias("f"), (F.exp(x.g - F.col("top")) / F.col("total")).alias("t"))).alias("candidates"))


def listwise_fit(lists: DataFrame, n_profiles: int, settings: Settings = Settings(centred=True), temperature: float = 1.0, held: str = "held", weight: str | None = None) -> Fit:
    """Fusion weights by ListNet over ``ranking_lists``: cross-entropy of the shares that the fused scores give."""

    def objective(rows, theta):
        w = softmax(theta)
        scored = rows.withColumn("_c", F.transform("candidates", lambda c: F.struct(c.f.alias("f"), c.t.alias("t"), _dot(w, c.f).alias("s"))))
        scored = scored.withColumn("_top", F.array_max(F.transform("_c", lambda c: c.s)))
        raised = F.transform("_c", lambda c: F.struct(c.f.alias("f"), c.t.alias("t"), c.s.alias("s"), F.exp((c.s - F.col("_top")) / temperature).alias("e")))
        rows = scored.withColumn("_c", raised).withColumn("_total", F.aggregate("_c", F.lit(0.0), lambda a, c: a + c.e))
        total = F.col("_total")

        def slope(j):
            return F.aggregate("_c", F.lit(0.0), lambda a, c: a + (c.e / total - c.t) / temperature * float(w[j]) * (c.f[j] - c.s))

        loss = F.aggregate("_c", F.lit(0.0), lambda a, c: a - c.t * F.log(F.greatest(c.e / total, F.lit(EPS))))
        return rows, loss, [slope(j) for j in range(n_profiles)]

    return descend(lists, objective, np.zeros(n_profiles), settings, held, weight)


def classifier_fit(rows: DataFrame, features: list[str], label: str, labels: list[str], settings: Settings = Settings(rate=0.5, clip=None), held: str = "held") -> Fit:
    """Multinomial logistic weights: theta is a (labels, 1 + features) table, flat; the first column is the bias.

    The bias carries the penalty too.  ``labels`` lists the classes; a row of another class is refused.
    """
    size = 1 + len(features)
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]

    def objective(rows, theta):
        known = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
        known = F.when(known >= 0, known).otherwise(F.raise_error(F.lit("a label that isn't listed")).cast("int"))
        rows = rows.select(held, F.array(*x).alias("_x"), known.alias("_y"))
        rows = rows.withColumn("_z", F.array(*[_dot(t, F.col("_x")) for t in theta.reshape(len(labels), size)]))
        rows = rows.withColumn("_top", F.array_max("_z"))
        rows = rows.withColumn("_e", F.transform("_z", lambda v: F.exp(v - F.col("_top")))).withColumn("_total", F.aggregate("_e", F.lit(0.0), lambda a, e: a + e))
        rows = rows.withColumn("_off", F.transform("_e", lambda e, i: e / F.col("_total") - (i == F.col("_y")).cast("double")))
        loss = F.log("_total") + F.col("_top") - F.get("_z", F.col("_y"))
        return rows, loss, [F.col("_off")[k] * F.col("_x")[j] for k in range(len(labels)) for j in range(size)]

    return descend(rows, objective, np.zeros(len(labels) * size), settings, held)


def classified(rows: DataFrame, theta: np.ndarray, features: list[str], labels: list[str], fallback: str, least: float = 0.0) -> DataFrame:
    """``rows`` with ``predicted`` and ``confidence``: the likeliest label (ties: the first listed), ``fallback`` below ``least``."""
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    rows = rows.withColumn("_x", x).withColumn("_z", F.array(*[_dot(t, F.col("_x")) for t in theta.reshape(len(labels), 1 + len(features))]))
    rows = rows.withColumn("_top", F.array_max("_z"))
    confidence = 1 / F.aggregate("_z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top")))
    rows = rows.withColumn("confidence", confidence)
    name = F.element_at(F.array(*map(F.lit, labels)), F.array_position("_z", F.col("_top")).cast("int"))
    return rows.withColumn("predicted", F.when(F.col("confidence") < least, fallback).otherwise(name)).drop("_x", "_z", "_top")


def plan_ranker_fit(pairs: DataFrame, differences: list[str], settings: Settings = Settings(rate=0.5, clip=None), held: str = "held", weight: str | None = None) -> Fit:
    """Weights that rank a preferred plan above a rejected one: softplus of the negative margin of their differences."""

    def objective(rows, theta):
        rows = rows.withColumn("_margin", sum((float(t) * F.col(d) for t, d in zip(theta, differences)), F.lit(0.0)))
        margin = F.col("_margin")
        slope = 1 / (1 + F.exp(margin))
        return rows, F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))), [-slope * F.col(d) for d in differences]

    return descend(pairs, objective, np.zeros(len(differences)), settings, held, weight)
