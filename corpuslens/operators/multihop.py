"""Evaluation of answers that need several documents, and gates over several paired metrics."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import normalized_answer
from corpuslens.operators.evidence import bag_f1
from corpuslens.operators.lineage import cut, small

METRICS = (
    "answer_exact", "answer_f1", "document_precision", "document_recall", "document_f1", "support_precision", "support_recall", "support_f1", "path_complete", "hop_coverage",
    "lineage_validity", "n_evidence", "abstained", "answer_support",
)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(normalized_answer(text), " "), lambda t: t != "")


def _ratio(n: Column, of: Column, empty: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(empty)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def multihop_metrics(examples: DataFrame, facts: DataFrame, predictions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``example`` and METRICS of each of ``examples(example, answers, required_hops)``.

    ``facts(example, fact, doc, locator)`` support the answer, ``predictions(example, answer, abstained)`` and
    ``evidence(example, evidence, doc, locators, hop, source)`` are what was given.  Evidence matches a fact of its
    document if the fact has no locator or one of the evidence's.  Units of evidence are a document with its set of
    locators.  A path is complete if each fact is matched; lineage is valid where evidence names its hop and source.
    Facts and evidence meet by example and document.  An example without a prediction abstains.
    """
    gold = facts.select("example", "fact", "doc", "locator")
    units = evidence.where("doc is not null").select("example", "doc", F.array_sort(F.array_distinct(F.coalesce("locators", F.array().cast("array<string>")))).alias("locators")).distinct()
    met = gold.join(units, ["example", "doc"]).where("locator is null or array_contains(locators, locator)")
    n = lambda df, *columns: df.groupBy("example").agg(*columns)
    docs = n(gold, F.collect_set("doc").alias("gold_docs"), F.count_distinct("fact").alias("n_facts"))
    given = n(
        evidence, F.collect_set("doc").alias("given_docs"), F.count("*").alias("n_evidence"), F.count_distinct("hop").alias("n_hops"),
        F.count(F.when(F.col("hop").isNotNull() & F.col("source").isNotNull(), 1)).alias("n_lineage"),
    )
    counts = n(met, F.count_distinct("fact").alias("matched"), F.count_distinct("doc", "locators").alias("matching"))
    rows = examples.join(predictions, "example", "left").join(docs, "example", "left").join(given, "example", "left").join(n(units, F.count("*").alias("n_units")), "example", "left").join(counts, "example", "left")
    rows = rows.na.fill(0, ["n_facts", "n_evidence", "n_hops", "n_lineage", "n_units", "matched", "matching"])
    none, zero, one = F.array(), F.lit(0.0), F.lit(1.0)
    gold_docs, given_docs = F.coalesce("gold_docs", none.cast("array<string>")), F.coalesce("given_docs", none.cast("array<string>"))
    shared, c = F.size(F.array_intersect(gold_docs, given_docs)), F.col
    said, mine = normalized_answer(F.coalesce("answer", F.lit(""))), _tokens(F.coalesce("answer", F.lit("")))
    best = lambda score: F.coalesce(F.array_max(F.transform("answers", score)), zero)
    rows = rows.select(
        "example", best(lambda a: (normalized_answer(a) == said).cast("double")).alias("answer_exact"), best(lambda a: bag_f1(mine, _tokens(a))).alias("answer_f1"),
        _ratio(shared, F.size(given_docs), F.when(F.size(gold_docs) == 0, one).otherwise(zero)).alias("document_precision"), _ratio(shared, F.size(gold_docs), one).alias("document_recall"),
        _ratio(c("matching"), c("n_units"), F.when(c("n_facts") == 0, one).otherwise(zero)).alias("support_precision"), _ratio(c("matched"), c("n_facts"), one).alias("support_recall"),
        (c("matched") == c("n_facts")).cast("double").alias("path_complete"), F.least(c("n_hops") / c("required_hops"), one).alias("hop_coverage"),
        _ratio(c("n_lineage"), c("n_evidence"), one).alias("lineage_validity"), c("n_evidence").cast("double").alias("n_evidence"),
        (F.coalesce("abstained", F.lit(False)) | (said == "")).cast("double").alias("abstained"),
    )
    rows = rows.withColumn("document_f1", _f1(c("document_precision"), c("document_recall"))).withColumn("support_f1", _f1(c("support_precision"), c("support_recall")))
    return rows.withColumn("answer_support", c("answer_f1") * c("support_recall")).select("example", *METRICS)


def mean_multihop(metrics: DataFrame, *by: str) -> DataFrame:
    """``by, n_examples`` and the mean of each of METRICS."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n_examples"), *[F.avg(m).alias(m) for m in METRICS])


def _hashed(k: int, before: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a further int column after ``before``, that of the columns before it."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (before + (p5 + np.uint64(4))) ^ (np.uint64(k) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _drawn_sums(d: DataFrame, seed: int, resamples: int, flips: int) -> DataFrame:
    """``metric, kind, k, w, s``: weights and weighted sums of ``d(metric, d, id)`` in each draw, one row of each for a task.

    A pair's draws come from 30 bits of a hash of seed, kind, metric, id and k; kind ``all`` is the plain sum.
    """
    mass, least = 2.718281828459045**-1, []
    for k in range(8):  # a Poisson draw of mean 1 by its distribution function, on the scale of the draws
        least.append((least[-1] if least else 0.0) + mass)
        mass /= k + 1
    steps = [np.uint64(int(np.ceil(x * (1 << 30)))) for x in least]

    def draw(batches):
        sums: dict[str, dict[tuple[str, int], list[float]]] = {}
        for batch in batches:
            for metric, rows in batch.groupby("metric", dropna=False):
                x, mine = rows["d"].to_numpy(), sums.setdefault(metric, defaultdict(lambda: [0.0, 0.0]))
                kinds = {c: rows[c].to_numpy().view("uint64") for c in ("bootstrap", "flip")}
                with np.errstate(over="ignore"):
                    parts = [("all", 0, np.ones(len(x)))]
                    for i in range(max(resamples, flips)):
                        if i < resamples:
                            h = _hashed(i, kinds["bootstrap"]) & np.uint64((1 << 30) - 1)
                            parts.append(("bootstrap", i, np.sum([h >= t for t in steps], axis=0, dtype="int64")))
                        if i < flips:
                            parts.append(("flip", i, np.where(_hashed(i, kinds["flip"]) & np.uint64(1 << 29), -1, 1)))
                        for kind, k, w in parts:
                            total = mine[kind, k]
                            total[0] += len(x) if kind == "flip" else w.sum()
                            total[1] += w @ x
                        parts = []
        rows = [(metric, kind, k, *total) for metric, mine in sums.items() for (kind, k), total in mine.items()]
        yield pd.DataFrame(rows, columns=["metric", "kind", "k", "w", "s"])

    hashes = [F.xxhash64(F.lit(seed), F.lit(kind), "metric", "id").alias(kind) for kind in ("bootstrap", "flip")]
    missing = F.raise_error(F.lit("a governed metric is missing")).cast("double")
    known = d.select("metric", F.when(F.col("d").isNull(), missing).otherwise(F.col("d")).alias("d"), *hashes)
    return known.mapInPandas(draw, f"metric {d.schema['metric'].dataType.simpleString()}, kind string, k int, w double, s double")


def promotion(pairs: DataFrame, rules: DataFrame, resamples: int = 400, flips: int = 400, confidence: float = 0.95, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``metric, mean_difference, low, high, p_value, adjusted_p, noninferior, significant, passed, promoted`` for each rule.

    ``pairs(metric, id, baseline, candidate)`` are paired values, ``rules(metric, higher_is_better, margin, require_significance)``
    the gates.  Intervals come from a bootstrap with Poisson weights, p-values from sign flips, both drawn by hashes of the
    pair, so reruns agree; Holm's correction runs over the rules.  A metric passes if its interval stays above the margin
    and, where asked, its corrected p-value reaches ``alpha``; ``promoted`` says whether all do.  A rule without pairs is
    refused.  Pairs are read once, where they lie; a task sums their draws, and resamples plus flips rows a metric leave it.
    """
    d = small(rules.select("metric", "higher_is_better"))
    d = d.join(pairs, "metric").select("metric", F.when(F.col("higher_is_better"), F.col("candidate") - F.col("baseline")).otherwise(F.col("baseline") - F.col("candidate")).alias("d"), "id")
    sums = cut(_drawn_sums(d, seed, resamples, flips).groupBy("metric", "kind", "k").agg(F.sum("w").alias("w"), F.sum("s").alias("s")))
    of = lambda kind: sums.where(F.col("kind") == kind).select("metric", "k", (F.col("s") / F.col("w")).alias("m"))
    tail = (1 - confidence) / 2
    interval = of("bootstrap").groupBy("metric").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    mean = rules.select("metric").join(of("all").select("metric", F.col("m").alias("mean_difference")), "metric", "left")
    missing = F.raise_error(F.lit("a governed metric is missing")).cast("double")
    mean = mean.withColumn("mean_difference", F.when(F.col("mean_difference").isNull(), missing).otherwise(F.col("mean_difference")))
    hits = of("flip").join(mean, "metric").groupBy("metric").agg(((F.sum((F.abs("m") >= F.abs("mean_difference") - 1e-12).cast("int")) + 1) / (flips + 1.0)).alias("p_value"))
    rows = rules.join(mean, "metric").join(interval, "metric", "left").join(hits, "metric", "left")
    order, all_ = Window.partitionBy().orderBy("p_value", "metric"), Window.partitionBy()  # as many rows as rules
    step = F.least(F.lit(1.0), F.col("p_value") * (F.count("*").over(all_) - F.row_number().over(order) + 1))
    rows = rows.withColumn("step", step).withColumn("adjusted_p", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("noninferior", F.col("low") >= -F.col("margin")).withColumn("significant", F.col("adjusted_p") <= alpha)
    rows = rows.withColumn("passed", F.col("noninferior") & (~F.col("require_significance") | F.col("significant"))).withColumn("promoted", F.min("passed").over(all_))
    return rows.select("metric", "mean_difference", "low", "high", "p_value", "adjusted_p", "noninferior", "significant", "passed", "promoted")


def compare_metrics(pairs: DataFrame, directions: DataFrame, resamples: int = 400, flips: int = 400, seed: int = 0) -> DataFrame:
    """``metric, n, baseline_mean, candidate_mean, raw_delta, improvement, effect, p_value, low, high`` of each metric.

    ``directions(metric, higher_is_better)`` put all on one scale on which more is better: improvement, effect (mean over
    standard deviation of the differences, null where they don't vary) and interval are turned round for the others.
    """
    pairs = cut(pairs)
    rules = directions.select("metric", "higher_is_better", F.lit(0.0).alias("margin"), F.lit(False).alias("require_significance"))
    drawn = promotion(pairs, rules, resamples, flips, seed=seed).select("metric", "mean_difference", "p_value", "low", "high")
    d = F.col("candidate") - F.col("baseline")
    own = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.avg(d).alias("raw_delta"), F.stddev_samp(d).alias("_s"))
    rows = own.join(drawn, "metric")
    effect = F.when(F.col("_s") > 1e-15, F.col("mean_difference") / F.col("_s"))
    return rows.select("metric", "n", "baseline_mean", "candidate_mean", "raw_delta", F.col("mean_difference").alias("improvement"), effect.alias("effect"), "p_value", "low", "high")
