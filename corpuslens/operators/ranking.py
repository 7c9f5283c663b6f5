"""Fusion, caps, diversity and packing of ranked lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import calibrated


def rank_fusion(lists: DataFrame, weights: dict[str, float], constant: int = 60, normalise: bool = True) -> DataFrame:
    """``query_id, doc_id, score`` from ``list, query_id, doc_id, position``: sum of weight / (constant + position).

    A repeat in a list counts at its first position; scores are divided by the query's best.
    """
    first = lists.groupBy("list", "query_id", "doc_id").agg(F.min("position").alias("position"))
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.create_map(*pairs)[F.col("list")], F.lit(1.0)) if pairs else F.lit(1.0)
    fused = first.groupBy("query_id", "doc_id").agg(F.sum(weight / (constant + F.col("position"))).alias("score"))
    if normalise:
        fused = fused.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    return fused


def capped(scored: DataFrame, k: int, per_source: int, source: str = "source") -> DataFrame:
    """The best ``k`` of each query with at most ``per_source`` of a source."""
    rank = (F.desc(F.round("score", 9)), F.desc("doc_id"))
    some = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", source).orderBy(*rank))).where(F.col("_n") <= per_source)
    return some.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*rank))).where(F.col("position") <= k).drop("_n")


def diverse(candidates: DataFrame, k: int, balance: float = 0.7, per_source: int = 3) -> DataFrame:
    """Greedy relevance against the largest token overlap with those chosen: ``query_id, doc_id, position``.

    ``candidates(query_id, doc_id, source, score, tokens)`` is a pool of bounded size for each query.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "doc_id"], ascending=[False, False]).to_dict("records")
        sets, chosen, used = [set(r["tokens"]) for r in rows], [], {}
        left = list(range(len(rows)))
        while left and len(chosen) < k:
            left = [i for i in left if used.get(rows[i]["source"], 0) < per_source]
            if not left:
                break

            def gain(i: int) -> float:
                near = max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0)
                return balance * rows[i]["score"] - (1 - balance) * near

            best = max(left, key=lambda i: (round(gain(i), 12), -i))
            chosen.append(best)
            left.remove(best)
            used[rows[best]["source"]] = used.get(rows[best]["source"], 0) + 1
        return pd.DataFrame({"query_id": [rows[i]["query_id"] for i in chosen], "doc_id": [rows[i]["doc_id"] for i in chosen], "position": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, position int")


def packed(candidates: DataFrame, budget: int, per_source: int = 2, redundancy: float = 0.2) -> DataFrame:
    """Greedy utility for each token under a budget, with a penalty for each item of the same source."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, spent, out = pdf.to_dict("records"), {}, 0, []
        while True:
            fits = [r for r in rows if r["n_tokens"] + spent <= budget and used.get(r["source"], 0) < per_source]
            if not fits:
                break
            best = max(fits, key=lambda r: (round((r["score"] - redundancy * used.get(r["source"], 0)) / max(1, r["n_tokens"]), 12), r["doc_id"]))
            rows.remove(best)
            used[best["source"]] = used.get(best["source"], 0) + 1
            spent += best["n_tokens"]
            out.append((best["query_id"], best["doc_id"], len(out) + 1, spent))
        return pd.DataFrame(out, columns=["query_id", "doc_id", "position", "spent"])

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, position int, spent long")


def frontier(points: DataFrame, key: str, up: list[str], down: list[str]) -> DataFrame:
    """Points that no other dominates: larger is better in ``up``, smaller in ``down``.

    Points are first reduced to those that are best for their exact values of all but one measure.
    """
    last, rest = down[-1], [*up, *down[:-1]]
    thin = points.withColumn("_best", F.min(last).over(Window.partitionBy(*rest))).where(F.col(last) == F.col("_best")).drop("_best")
    other = thin.select(*[F.col(c).alias(f"_{c}") for c in [*up, *down]]).distinct()
    as_good = [F.col(f"_{c}") >= F.col(c) for c in up] + [F.col(f"_{c}") <= F.col(c) for c in down]
    better = [F.col(f"_{c}") > F.col(c) for c in up] + [F.col(f"_{c}") < F.col(c) for c in down]
    test = as_good[0]
    for x in as_good[1:]:
        test = test & x
    any_better = better[0]
    for x in better[1:]:
        any_better = any_better | x
    return thin.join(other, test & any_better, "left_anti")


def runs(rows: DataFrame, keys: list[str], place: str, flag: str) -> DataFrame:
    """Adds ``run``: the number of each stretch of consecutive places where ``flag`` holds (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(place)
    starts = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    return rows.withColumn("_start", starts).withColumn("run", F.sum("_start").over(w)).where(flag).drop("_start")


def weighted_scores(lists: DataFrame, weights: dict[str, float], calibrations: dict[str, tuple[float, float]] | None = None, logit: bool = False) -> DataFrame:
    """``query_id, doc_id, score`` from ``list, query_id, doc_id, score`` (0 to 1): weighted mean over the lists that hold it.

    A repeat counts with its best score.  ``calibrations`` are (temperature, bias) for each list; with ``logit`` the mean is
    of the log odds and the score its probability.
    """
    best = lists.groupBy("list", "query_id", "doc_id").agg(F.max(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("p"))
    p = F.col("p")
    for name, (temperature, bias) in (calibrations or {}).items():
        p = F.when(F.col("list") == name, calibrated(F.col("p"), temperature, bias)).otherwise(p)
    odds = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    value = F.log(odds / (1 - odds)) if logit else p
    w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("list")], F.lit(0.0))
    g = best.groupBy("query_id", "doc_id").agg((F.sum(w * value) / F.sum(w)).alias("score"))
    return g.withColumn("score", 1 / (1 + F.exp(-F.col("score")))) if logit else g


def federated_merge(
    hits: DataFrame, expected: DataFrame, weights: DataFrame, modalities: tuple[str, ...] = (), k: float = 60.0, most_per_provider: int = 50, limit: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """The merged list of a request, ``request, item, provider, collection, score, position``, and the collections that are missing.

    ``hits(request, provider, collection, item, modality, rank)`` come from collections that ``expected(request, provider,
    collection)`` allows; one that it doesn't is refused.  Of each collection the ``most_per_provider`` first hits of the
    ``modalities`` count (of any where none is named), as weight / (k + rank) with ``weights(provider, weight)`` or 1.  An
    item's best place stays (ties by provider, collection and rank).  Missing is what was expected and gave no hit.
    """
    n = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keys = ["request", "provider", "collection"]
    allowed = hits.join(expected.select(*keys, F.lit(True).alias("_known")), keys, "left")
    known = F.when(F.col("_known"), F.col("rank")).otherwise(F.raise_error(F.lit("a collection that was not asked")).cast("int"))
    wanted = allowed.withColumn("rank", known)
    wanted = wanted.where(F.col("modality").isin(*modalities)) if modalities else wanted
    wanted = wanted.withColumn("_n", n(keys, "rank", "item")).where(F.col("_n") <= most_per_provider)
    scored = wanted.join(weights, "provider", "left").withColumn("score", F.coalesce("weight", F.lit(1.0)) / (k + F.col("rank")))
    order = [F.desc("score"), "provider", "collection", "rank", "item"]
    best = scored.withColumn("_n", n(["request", "item"], *order)).where("_n = 1")
    placed = best.withColumn("position", n(["request"], *order)).where(F.col("position") <= limit)
    missing = expected.select(*keys).join(hits.select(*keys).distinct(), keys, "left_anti")
    return placed.select("request", "item", "provider", "collection", "score", "position"), missing
