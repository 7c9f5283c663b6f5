"""Fits against the same descent in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import fitting
from corpuslens.plans import catalog, mechanisms

SF = "/root/testdata/sf0.001"


def numpy_descent(parts, start, s, objective):
    """``objective(part, theta)`` gives mean loss and gradient of one part of the rows."""
    theta, best, stale = np.array(start, float), None, 0
    for epoch in range(1, s.epochs + 1):
        g = objective(parts[False], theta)[1] + s.l2 * theta
        if s.clip and np.linalg.norm(g) > s.clip:
            g = g * s.clip / np.linalg.norm(g)
        theta = theta - s.rate * g
        if s.centred:
            theta = theta - theta.mean()
        loss = objective(parts[True], theta)[0] + (0 if s.centred else 0.5 * s.l2 * theta @ theta)
        if best is None or loss < best[1] - s.min_delta:
            best, stale = (epoch, loss, theta.copy()), 0
        else:
            stale += 1
            if stale >= s.patience:
                break
    return best


def same(fit, expected):
    assert fit.best_epoch == expected[0]
    assert abs(fit.best_loss - expected[1]) < 1e-6
    assert np.allclose(fit.theta, expected[2], atol=1e-6)


def log_odds(p):
    return np.log(p / (1 - p))


def test_fusion_and_listwise_fits(spark):
    rows = mechanisms.fused_rows(spark, SF).withColumn("relevant", F.col("grade") > 0)
    pdf = rows.toPandas()
    assert pdf.held.nunique() == 2 and pdf.groupby("query_id").grade.nunique().max() > 1
    parts = {h: (log_odds(g[["dense", "lexical"]].to_numpy()), g.relevant.to_numpy(float)) for h, g in pdf.groupby("held")}

    def cross_entropy(part, theta):
        x, y = part
        w = fitting.softmax(theta)
        s = x @ w
        p = 1 / (1 + np.exp(-s))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), np.mean((p - y)[:, None] * w * (x - s[:, None]), axis=0)

    settings = fitting.Settings(epochs=6, centred=True, rate=0.2)
    fit = fitting.fusion_fit(rows, ["dense", "lexical"], "relevant", settings)
    same(fit, numpy_descent(parts, np.zeros(2), settings, cross_entropy))
    assert abs(fit.weights.sum() - 1) < 1e-12 and fit.weights.min() >= 0

    lists = {h: [(log_odds(q[["dense", "lexical"]].to_numpy()), q.grade.to_numpy()) for _, q in g.groupby("query_id") if q.grade.nunique() > 1] for h, g in pdf.groupby("held")}

    def listnet(part, theta):
        w, losses, grads = fitting.softmax(theta), [], []
        for x, grade in part:
            s, t = x @ w, fitting.softmax(grade)
            p = fitting.softmax(s)
            losses.append(-np.sum(t * np.log(p)))
            grads.append(np.sum((p - t)[:, None] * w * (x - s[:, None]), axis=0))
        return np.mean(losses), np.mean(grads, axis=0)

    table = fitting.ranking_lists(rows, ["dense", "lexical"], "grade")
    same(fitting.listwise_fit(table, 2, settings), numpy_descent(lists, np.zeros(2), settings, listnet))


def test_listwise_prefers_the_better_profile(spark):
    """Of two profiles the one that follows the grades gets most of the weight."""
    rows = [(q, i, p, 1 - p, float(i), q == 3) for q in range(4) for i, p in enumerate((0.2, 0.5, 0.9))]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, good double, bad double, grade double, held boolean")
    fit = fitting.listwise_fit(fitting.ranking_lists(df, ["good", "bad"], "grade"), 2, fitting.Settings(epochs=15, rate=1.0, centred=True))
    assert fit.weights[0] > 0.65
    flat = df.withColumn("grade", F.lit(1.0))
    with pytest.raises(ValueError, match="no rows"):
        fitting.listwise_fit(fitting.ranking_lists(flat, ["good", "bad"], "grade"), 2)


def test_classifier_fit(spark):
    rows = mechanisms.letter_rows(spark, SF)
    pdf, features = rows.toPandas(), [f"l_{c}" for c in mechanisms.LETTERS]
    labels = sorted(pdf.lang.unique())
    parts = {h: (np.column_stack([np.ones(len(g)), g[features].to_numpy()]), np.array([labels.index(v) for v in g.lang])) for h, g in pdf.groupby("held")}

    def multinomial(part, theta):
        x, y = part
        z = x @ theta.reshape(len(labels), -1).T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        hit = np.eye(len(labels))[y]
        return -np.mean(np.log((p * hit).sum(axis=1))), ((p - hit).T @ x / len(x)).ravel()

    settings = fitting.Settings(epochs=8, rate=0.5, clip=None, min_delta=1e-3, patience=3)
    fit = fitting.classifier_fit(rows, features, "lang", labels, settings)
    same(fit, numpy_descent(parts, np.zeros(len(labels) * (1 + len(features))), settings, multinomial))
    x, y = parts[True]
    top = (x @ fit.theta.reshape(len(labels), -1).T).argmax(axis=1)
    got = fitting.classified(rows.where("held"), fit.theta, features, labels, "und").toPandas()
    assert abs((got.predicted == got.lang).mean() - (top == y).mean()) < 1e-9
    with pytest.raises(Exception, match="isn't listed"):
        fitting.classifier_fit(rows, features, "lang", labels[:-1], settings)


def test_classifier_stops_early(spark):
    """Held labels that contradict the others: the first epoch is the best, and patience ends the fit."""
    df = spark.createDataFrame([(float(i % 2), "a" if i % 2 else "b", False) for i in range(40)] + [(float(i % 2), "b" if i % 2 else "a", True) for i in range(10)], "x double, y string, held boolean")
    fit = fitting.classifier_fit(df, ["x"], "y", ["a", "b"], fitting.Settings(epochs=50, rate=0.5, clip=None, patience=4))
    assert fit.best_epoch == 1 and len(fit.history) == 5
    assert all(f.predicted == "none" for f in fitting.classified(df, fit.theta, ["x"], ["a", "b"], "none", 0.99).collect())


def test_plan_ranker_fit(spark):
    pairs = mechanisms.plan_pairs(spark, SF)
    pdf = pairs.toPandas()
    parts = {h: g[mechanisms.PLAN_FEATURES].to_numpy() for h, g in pdf.groupby("held")}

    def softplus(x, theta):
        m = x @ theta
        return np.mean(np.log1p(np.exp(-m))), np.mean(-(1 / (1 + np.exp(m)))[:, None] * x, axis=0)

    settings = fitting.Settings(epochs=6, rate=0.5, clip=None, min_delta=0.0)
    same(fitting.plan_ranker_fit(pairs, mechanisms.PLAN_FEATURES, settings), numpy_descent(parts, np.zeros(4), settings, softplus))
    rows = catalog.queries()["h65_plan_ranker"](spark, SF).collect()
    assert [r.feature for r in rows] == mechanisms.PLAN_FEATURES
