"""Gates, authority floors, sets of support and reports over tables of measurements."""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpuslens.operators.statistics import histogram, js_divergence, stability_index


def linear_ranks(features: DataFrame, weights: dict[str, float], group: str, item: str) -> DataFrame:
    """``group, item, score, position`` from ``features(group, item, feature, value)``: unknown features weigh nothing."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    scored = features.groupBy(group, item).agg(F.sum(F.col("value") * F.coalesce(table[F.col("feature")], F.lit(0.0))).alias("score"))
    order = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), item)
    return scored.withColumn("position", F.row_number().over(order))


def threshold_gates(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Adds ``failures`` (names of the metrics outside their limits, null among them) and ``passed``."""
    low = [F.when(~F.coalesce(F.col(k) >= v, F.lit(False)), F.lit(k)) for k, v in least.items()]
    high = [F.when(~F.coalesce(F.col(k) <= v, F.lit(False)), F.lit(k)) for k, v in most.items()]
    checked = metrics.withColumn("failures", F.array_sort(F.array_compact(F.array(*low, *high))))
    return checked.withColumn("passed", F.size("failures") == 0)


def authority(rows: DataFrame, confidences: Sequence[str], allow: float, review: float, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``floor`` and ``action``: the least confidence, over ``group`` where given, decides allow, review or block.

    A missing confidence blocks.
    """
    floor = F.array_min(F.array(*[F.coalesce(F.col(c), F.lit(-1.0)) for c in confidences]))
    rows = rows.withColumn("floor", floor) if not group else rows.groupBy(*group).agg(F.min(floor).alias("floor"), F.count("*").alias("n"))
    return rows.withColumn("action", F.when(F.col("floor") >= allow, "allow").when(F.col("floor") >= review, "review").otherwise("block"))


def structure_quality(regions: DataFrame, document: str, kind: str, confidence: str, low: float = 0.5) -> DataFrame:
    """Rates over the regions of each document: ``n_regions, mean_confidence, low_share, table_share, missing_share``."""
    share = lambda c, name: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name)
    return regions.groupBy(document).agg(
        F.count("*").alias("n_regions"), F.avg(confidence).alias("mean_confidence"), share(F.col(confidence) < low, "low_share"),
        share(F.col(kind) == "table", "table_share"), share(F.col(confidence).isNull(), "missing_share"),
    )


def multiclass_brier(examples: DataFrame, probabilities: dict[str, str], truth: str, abstained: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean over examples that weren't abstained of the sum of squared errors over the labels: ``n, brier``."""
    error = sum((F.pow(F.col(p) - F.when(F.col(truth) == label, 1.0).otherwise(0.0), 2) for label, p in probabilities.items()), F.lit(0.0))
    return examples.where(~F.col(abstained)).groupBy(*group).agg(F.count("*").alias("n"), F.avg(error).alias("brier"))


def semantic_report(examples: DataFrame, predicted: str, truth: str, abstained: str, against: str, group: Sequence[str] = ()) -> DataFrame:
    """``coverage, accuracy, miss_rate``: decided examples, right ones among them, and the share of examples labelled
    ``against`` that were decided otherwise."""
    decided = ~F.col(abstained)
    rate = lambda c, among: F.avg(F.when(among, F.when(c, 1.0).otherwise(0.0)))
    return examples.groupBy(*group).agg(
        F.avg(F.when(decided, 1.0).otherwise(0.0)).alias("coverage"), rate(F.col(predicted) == F.col(truth), decided).alias("accuracy"),
        rate(F.col(predicted) != against, decided & (F.col(truth) == against)).alias("miss_rate"),
    )


def unsupported_claims(pairs: DataFrame, key: Sequence[str], answer: str, evidence_tokens: str, threshold: float = 0.5) -> DataFrame:
    """``n_claims, unsupported_rate``: a sentence is unsupported if less than ``threshold`` of its distinct tokens are in the evidence."""
    claims = pairs.select(*key, evidence_tokens, F.explode(F.split(F.lower(answer), r"[.!?]+")).alias("claim"))
    tokens = F.array_distinct(F.regexp_extract_all("claim", F.lit(r"([\p{L}\p{N}_]+)"), 1))
    claims = claims.select(*key, evidence_tokens, tokens.alias("t")).where(F.size("t") > 0)
    covered = F.size(F.array_intersect("t", evidence_tokens)) / F.size("t")
    return claims.groupBy(*key).agg(F.count("*").alias("n_claims"), F.avg(F.when(covered < threshold, 1.0).otherwise(0.0)).alias("unsupported_rate"))


def conformal_sets(queries: DataFrame, candidates: DataFrame, threshold: float, most: int, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Candidates of each query whose ``nonconformity`` is within ``threshold``, the best ``most``; else one abstain row.

    Returns ``group, item, position, abstained``.
    """
    order = Window.partitionBy(group).orderBy(F.round("nonconformity", 9), item)
    kept = candidates.where(F.col("nonconformity") <= threshold).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return queries.select(group).distinct().join(kept.select(group, item, "position"), group, "left").withColumn("abstained", F.col(item).isNull())


def wilson_low(wins: Column, n: Column, z: float = 1.959964) -> Column:
    """Lower bound of Wilson's interval of a share; 0 without trials."""
    p = wins / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(F.lit(0.0))


def evidence_certainty(judgements: DataFrame, keys: Sequence[str], start: str, adjustment: str, reviewed: str) -> DataFrame:
    """``level, reviewed_share, unresolved`` of each question: start level plus summed adjustments, within 1 to 4."""
    level = F.least(F.lit(4), F.greatest(F.lit(1), F.max(start) + F.sum(F.coalesce(F.col(adjustment), F.lit(0)))))
    return judgements.groupBy(*keys).agg(
        level.cast("int").alias("level"), F.avg(F.when(F.col(reviewed), 1.0).otherwise(0.0)).alias("reviewed_share"),
        F.count(F.when(F.col(adjustment).isNull(), 1)).alias("unresolved"),
    )


def abstention_threshold(values: DataFrame, group: Sequence[str], confidence: str, wrong: str, most_risk: float, least_coverage: float) -> DataFrame:
    """The largest coverage of each group whose risk is within ``most_risk``: ``threshold, coverage, risk``.

    Equal confidences are one point; points are summed before they are ordered.
    """
    points = values.groupBy(*group, confidence).agg(F.count("*").alias("n"), F.sum(F.col(wrong).cast("int")).alias("bad"))
    order = Window.partitionBy(*group).orderBy(F.desc(confidence))
    whole = Window.partitionBy(*group)
    curve = points.select(
        *group, F.col(confidence).alias("threshold"), (F.sum("n").over(order) / F.sum("n").over(whole)).alias("coverage"),
        (F.sum("bad").over(order) / F.sum("n").over(order)).alias("risk"),
    )
    fit = curve.where((F.col("risk") <= most_risk) & (F.col("coverage") >= least_coverage))
    return fit.groupBy(*group).agg(F.max_by(F.struct("threshold", "coverage", "risk"), "coverage").alias("x")).select(*group, "x.*")


def mined_negatives(ranked: DataFrame, gains: DataFrame, skip: int = 2, keep: int = 5) -> DataFrame:
    """``query_id, doc_id, position, refused``: ranked items past the first ``skip`` without a gain, the first ``keep`` of each query.

    ``refused`` counts the query's items that were too high or relevant.
    """
    known = ranked.dropDuplicates(["query_id", "doc_id"]).join(gains.select("query_id", "doc_id", F.lit(True).alias("relevant")), ["query_id", "doc_id"], "left")
    out = F.coalesce("relevant", F.lit(False)) | (F.col("position") <= skip)
    known = known.withColumn("refused", F.sum(out.cast("int")).over(Window.partitionBy("query_id")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "doc_id"))
    return known.where(~out).withColumn("nth", nth).where(F.col("nth") <= keep).select("query_id", "doc_id", "position", "refused")


def cache_hits(queries: DataFrame, entries: DataFrame, similarity: Column, least: float = 0.92, most_age: float | None = None) -> DataFrame:
    """The best cached entry of each query in its partition: ``query_id, entry_id, similarity``.

    ``queries(query_id, part, q, at)`` meet ``entries(entry_id, part, e, stored, stale)`` of the same partition; stale or
    too old entries don't count; ties go to the newest, then the first id.
    """
    j = queries.join(entries.where("not stale"), "part").where((F.col("query_id") != F.col("entry_id")) & (F.col("stored") <= F.col("at")))
    if most_age is not None:
        j = j.where(F.col("at") - F.col("stored") <= most_age)
    j = j.withColumn("similarity", F.round(similarity, 9)).where(F.col("similarity") >= least)
    best = F.struct("similarity", "stored", (-F.col("entry_id")).alias("first"))
    return j.groupBy("query_id").agg(F.max(best).alias("x")).select("query_id", (-F.col("x.first")).alias("entry_id"), F.col("x.similarity").alias("similarity"))


def store_repairs(manifest: DataFrame, sparse: DataFrame, dense: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows between stores that differ and the action for each: ``key, action``.

    ``manifest(key, version, deleted)``; ``sparse(key, sparse_version)``; ``dense(key, dense_version)``.
    """
    j = manifest.join(sparse, key, "full_outer").join(dense, key, "full_outer")
    none = F.col("sparse_version").isNull() & F.col("dense_version").isNull()
    action = (
        F.when(F.col("version").isNull(), "remove_unmanifested")
        .when(F.col("deleted"), F.when(~none, "delete_everywhere"))
        .when(none, "rebuild_both").when(F.col("sparse_version").isNull(), "rebuild_sparse").when(F.col("dense_version").isNull(), "rebuild_dense")
        .when((F.col("sparse_version") != F.col("version")) | (F.col("dense_version") != F.col("version")), "reindex")
    )
    return j.select(key, action.alias("action")).where("action is not null")


def _frontier(points: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates (all columns at least as large, one larger)."""
    keep = np.ones(len(points), bool)
    for i in np.argsort(-points.sum(axis=1), kind="stable"):
        if keep[i]:
            worse = (points <= points[i]).all(axis=1) & (points < points[i]).any(axis=1)
            keep &= ~worse
    return keep


#: Tasks that merge the frontiers of all others before the last merge.
FRONTIER_PARTS = 64


def pareto_frontier(points: DataFrame, best_high: Sequence[str], best_low: Sequence[str]) -> DataFrame:
    """Rows that no other row dominates.

    Each task keeps the frontier of its rows, which holds every row of the whole one.  What is left is shuffled to
    FRONTIER_PARTS tasks that do the same, and only their frontiers meet in one task.
    """

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            held = held[_frontier(np.column_stack([*[held[c] for c in best_high], *[-held[c] for c in best_low]]).astype(float))]
        if held is not None:
            yield held

    first = points.mapInPandas(local, points.schema).repartition(FRONTIER_PARTS, *best_high, *best_low).mapInPandas(local, points.schema)
    return first.repartition(1).mapInPandas(local, points.schema)


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays."""

    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        names = {w: i for i, w in enumerate(set(x) | set(y))}
        x, y = np.array([names[w] for w in x]), np.array([names[w] for w in y])
        row = np.zeros(len(y) + 1, np.int64)
        for w in x:
            step = np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0))
            row = np.concatenate([[0], np.maximum.accumulate(step)])
        return 2.0 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def snippet(text: Column, terms: Column, before: int = 180, after: int = 420) -> Column:
    """Text around the earliest of ``terms``, from ``before`` characters before it to ``after`` after it, widened to spaces."""
    hits = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda i: i > 0)
    at = F.coalesce(F.array_min(hits), F.lit(1))
    start, end = F.greatest(F.lit(1), at - before), at + after
    start = F.when(start > 1, start - F.coalesce(F.length(F.regexp_extract(F.substring(text, F.lit(1), start - 1), r"(\S*)\z", 1)), F.lit(0))).otherwise(start)
    rest = F.length(F.regexp_extract(F.substring(text, end, F.length(text)), r"^(\S*)", 1))
    return F.trim(F.substring(text, start, end - start + rest))


def promotion_reasons(gains: dict[str, tuple[str, str, float]], ratios: dict[str, tuple[str, str, float]]) -> Column:
    """Why a candidate is held back: ``gains`` name (baseline, candidate, least difference), ``ratios`` (.., most ratio)."""
    held = [F.when(F.col(c) - F.col(b) < least, F.lit(k)) for k, (b, c, least) in gains.items()]
    held += [F.when(F.col(c) > most * F.col(b), F.lit(k)) for k, (b, c, most) in ratios.items()]
    return F.array_sort(F.array_compact(F.array(*held)))


def weighted_line(rows: DataFrame, group: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares of y on one moderator, from grouped sums: ``n, slope, intercept, q``.

    ``q`` is the weighted residual sum of squares.
    """
    wx, wy = F.col(w) * F.col(x), F.col(w) * F.col(y)
    s = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(wx).alias("sx"), F.sum(wy).alias("sy"),
        F.sum(wx * F.col(x)).alias("sxx"), F.sum(wx * F.col(y)).alias("sxy"), F.sum(wy * F.col(y)).alias("syy"),
    )
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw"))
    return s.select(*group, "n", "slope", "intercept", (F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")).alias("q"))


def heuristic_scores(candidates: DataFrame, query_tokens: str, tokens: str) -> DataFrame:
    """Adds ``score``: 0.65 coverage of the query's tokens, 0.2 density of their places, 0.15 for the exact phrase."""
    # query tokens are few: counts of each in the candidate are read from its array
    counts = lambda array, t: F.size(F.filter(array, lambda w: w == t))
    shared = F.aggregate(F.array_distinct(query_tokens), F.lit(0), lambda a, t: a + F.least(counts(F.col(query_tokens), t), counts(F.col(tokens), t)))
    at = F.filter(F.transform(tokens, lambda w, i: F.when(F.array_contains(query_tokens, w), i)), lambda i: i.isNotNull())
    rows = candidates.withColumn("_at", at)
    proximity = F.when(F.size("_at") > 0, F.least(F.lit(1.0), F.size("_at") / (F.array_max("_at") - F.array_min("_at") + 1))).otherwise(0.0)
    phrase = F.when(F.contains(F.array_join(tokens, " "), F.array_join(query_tokens, " ")), 1.0).otherwise(0.0)
    score = F.when(F.size(query_tokens) > 0, 0.65 * shared / F.size(query_tokens) + 0.2 * proximity + 0.15 * phrase).otherwise(0.0)
    return rows.withColumn("score", F.least(F.lit(1.0), score)).drop("_at")


def admissible_claims(citations: DataFrame, trust: DataFrame, answer: str, claim: str, source: str, least: int = 1) -> DataFrame:
    """``answer, claim, cited, admitted, kept``: a claim is kept if ``least`` distinct cited sources are admitted.

    ``trust(source, admitted)``; a source without a decision isn't admitted.
    """
    j = citations.join(trust.where("admitted").select(F.col("source").alias(source), F.lit(True).alias("_ok")).distinct(), source, "left")
    g = j.groupBy(answer, claim).agg(F.countDistinct(source).alias("cited"), F.countDistinct(F.when(F.col("_ok"), F.col(source))).alias("admitted"))
    return g.withColumn("kept", F.col("admitted") >= least)


def drift_by_profile(reference: DataFrame, live: DataFrame, edges: list[float], profile: str = "profile", score: str = "score") -> DataFrame:
    """``psi, jsd`` of each profile's live scores against its reference, over bins of ``edges``."""
    a = histogram(reference, score, edges, (profile,)).select(profile, "bin", F.col("share").alias("r"))
    b = histogram(live, score, edges, (profile,)).select(profile, "bin", F.col("share").alias("c"))
    j = a.join(b, [profile, "bin"], "full_outer").fillna(0.0, ["r", "c"])
    return j.groupBy(profile).agg(stability_index(F.col("r"), F.col("c")).alias("psi"), js_divergence(F.col("r"), F.col("c")).alias("jsd"))


def series_summary(rows: DataFrame, group: Sequence[str], scenario: str, kind: str) -> DataFrame:
    """``n, scenarios, kinds``: rows, distinct scenarios and the sorted distinct kinds of each group."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct(scenario).alias("scenarios"), F.sort_array(F.collect_set(kind)).alias("kinds"))


def position_report(means: DataFrame, position: str = "position", score: str = "score") -> DataFrame:
    """One row: ``n_positions, score_range, edge_to_middle_gap, slope`` of a mean score for each position.

    Edges are the first and last position, the middle is the one at half of their number; with one position the slope is 0.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(score).alias("s")))), lambda x: x.s)  # as many as positions
    g = means.agg(ordered.alias("s"), F.regr_slope(score, position).alias("slope"), F.max(score).alias("top"), F.min(score).alias("low"), F.count("*").alias("n_positions"))
    middle = F.get("s", F.floor(F.col("n_positions") / 2).cast("int"))
    edges = (F.element_at("s", 1) + F.element_at("s", -1)) / 2
    return g.where("n_positions > 0").select("n_positions", (F.col("top") - F.col("low")).alias("score_range"), (edges - middle).alias("edge_to_middle_gap"), F.coalesce("slope", F.lit(0.0)).alias("slope"))


def index_adaptation(
    snapshots: DataFrame, shadow_psi: float = 0.2, urgent_psi: float = 0.4, score_drop: float = 0.1, stale: float = 0.15, failed: float = 0.05,
) -> DataFrame:
    """Adds ``action`` (stable, shadow_rebuild, urgent_rebuild) and ``reasons`` to ``snapshots(query_psi, language_psi, score_drop, stale_share, failed_share)``."""
    psi = F.greatest("query_psi", "language_psi")
    critical, broken = psi >= urgent_psi, F.col("failed_share") >= failed
    reasons = F.array_compact(F.array(
        F.when(critical, "distribution_shift_critical").when(psi >= shadow_psi, "distribution_shift_detected"), F.when(F.col("score_drop") >= score_drop, "retrieval_quality_dropped"),
        F.when(F.col("stale_share") >= stale, "stale_document_fraction_high"), F.when(broken, "index_update_failures_high"),
    ))
    action = F.when(F.size("reasons") == 0, "stable").when(F.coalesce(critical | broken, F.lit(False)), "urgent_rebuild").otherwise("shadow_rebuild")
    return snapshots.withColumn("reasons", reasons).withColumn("action", action)


#: Features of a source with their weights, and the states that block it.
TRUST = {"provenance": 0.3, "methodology": 0.25, "applicability": 0.2, "freshness": 0.1, "replication": 0.15}
BLOCKED = ("retracted", "withdrawn")


def source_trust(
    sources: DataFrame, weights: dict[str, float] | None = None, least: float = 0.5, blocked: Sequence[str] = BLOCKED, causal: bool = False, review_causal: bool = True,
) -> DataFrame:
    """Adds ``score, eligible, reasons`` to ``sources(source, <features>, status, reviewed, conflicts_known)``.

    The score is the weighted mean of the features.  A blocked status, a provenance below 0.5, a causal claim on a source
    that nobody reviewed, and a score below ``least`` each make a source ineligible; unknown conflicts of interest are only
    noted.  Eligible sources come first, then by score, then by name.
    """
    weights = TRUST if weights is None else weights
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    rows = sources.withColumn("score", score)
    bad = {
        "blocked_status": F.col("status").isin(*blocked), "weak_provenance_integrity": F.col("provenance") < 0.5,
        "causal_claim_requires_reviewed_source": F.lit(causal and review_causal) & ~F.col("reviewed"), "below_policy_score": F.col("score") < least,
    }
    no = F.lit(False)
    named = [F.when(F.coalesce(c, no), F.concat(F.lit("blocked_status:"), "status") if k == "blocked_status" else F.lit(k)) for k, c in bad.items()]
    found = F.array_compact(F.array(*named, F.when(~F.coalesce(F.col("conflicts_known"), no), F.lit("conflict_of_interest_status_unknown"))))
    eligible = reduce(lambda a, b: a & ~F.coalesce(b, no), bad.values(), F.lit(True))
    rows = rows.withColumn("eligible", eligible).withColumn("reasons", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("policy_eligible"))))
    return rows.orderBy(F.desc("eligible"), F.desc("score"), "source")


def plan_features(attempts: DataFrame) -> DataFrame:
    """``attempts(complexity, exact_identifier, methodological, mode, multi_query, hyde, reranker, cost)`` with the features of each plan."""
    is_ = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    mode, reranks = F.col("mode"), F.col("reranker") != "none"
    features = {
        "f_bias": F.lit(1.0), "f_complexity": F.col("complexity"), "f_cost": F.least(F.col("cost") / 100.0, F.lit(1.0)), "f_dense": is_(mode == "dense"), "f_sparse": is_(mode == "corpus-sparse"),
        "f_hybrid": is_(mode == "corpus-hybrid"), "f_multi_query": is_(F.col("multi_query")), "f_hyde": is_(F.col("hyde")), "f_reranker": is_(reranks),
        "f_exact_sparse_match": is_(F.col("exact_identifier") & (mode == "corpus-sparse")), "f_complex_hybrid_match": is_((F.col("complexity") >= 0.45) & (mode == "corpus-hybrid")),
        "f_method_rerank_match": is_(F.col("methodological") & reranks),
    }
    return attempts.select("*", *[c.alias(k) for k, c in features.items()])


def freeboard(structures: DataFrame, points: DataFrame, units: dict[str, float], tolerance: float = 0.0) -> DataFrame:
    """``structure, crest, water, freeboard, overtopping`` of ``structures(structure, river, reach, station, crest, unit, datum)``.

    The water surface is that of the one point of ``points(river, reach, station, water, unit, datum)`` at the structure's
    station, or, if ``tolerance`` allows, of the nearest within it; names count in any case.  It is converted by
    ``units`` (metres a unit).  Several points at one station, another datum and a missing crest are refused; a structure
    without a point has nulls.
    """
    scale = lambda c: F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(v))])[F.col(c)]
    low = lambda c: F.lower(F.col(c))
    s = structures.select("structure", low("river").alias("river"), low("reach").alias("reach"), "station", F.when(F.col("crest").isNull(), F.raise_error(F.lit("a structure without a crest")).cast("double")).otherwise(F.col("crest")).alias("crest"), scale("unit").alias("_su"), F.col("datum").alias("_sd"))
    p = points.where("water is not null").select(low("river").alias("river"), low("reach").alias("reach"), F.col("station").alias("_at"), "water", scale("unit").alias("_pu"), F.col("datum").alias("_pd"))
    gap = F.abs(F.col("_at") - F.col("station"))
    met = s.join(p, ["river", "reach"]).withColumn("_gap", gap).where(F.col("_gap") <= tolerance)
    best = met.groupBy("structure").agg(F.min("_gap").alias("_gap"))
    found = met.join(best, ["structure", "_gap"]).groupBy("structure").agg(F.count("*").alias("_n"), F.first("water").alias("water"), F.first("_pu").alias("_pu"), F.first("_pd").alias("_pd"))
    rows = s.join(found, "structure", "left")
    refused = lambda message: F.raise_error(F.lit(message)).cast("double")
    water = F.when(F.col("_n") > 1, refused("several points match a structure")).when(F.col("_pd") != F.col("_sd"), refused("another vertical datum")).otherwise(F.col("water") * F.col("_pu") / F.col("_su"))
    rows = rows.withColumn("water", water).withColumn("freeboard", F.col("crest") - F.col("water"))
    return rows.select("structure", "crest", "water", "freeboard", (F.col("freeboard") < 0).alias("overtopping"))
