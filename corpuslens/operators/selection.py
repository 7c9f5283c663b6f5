"""Greedy choices for each question: covers, packs, interleavings, batches and refined citations.

Each choice depends on the ones before it, so a question's candidates meet in one task. They are the few that a search
or a rater gave that question; questions are spread over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _for_each(rows: DataFrame, key: str, columns: str, choose: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """``choose`` applied to each key's rows; ``columns`` is the schema of what it gives, after the key.

    A key's rows are gathered in one row first, so that a batch holds many keys.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            plain = [[r if isinstance(r, dict) else r.asDict() for r in rows] for rows in pdf["_rows"]]
            yield pd.DataFrame([(k, *r) for k, rows in zip(pdf[key], plain, strict=True) for r in choose(rows)], columns=[key, *names])

    gathered = rows.groupBy(key).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    return gathered.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {columns}")


def evidence_cover(evidence: DataFrame, key: str = "question", independent: bool = True) -> DataFrame:
    """A small set of evidence that supports every claim that any supports: ``question, evidence, position, new_claims``.

    ``evidence(question, evidence, root, score, claims)``: most new claims first, then a root not used, score, fewer claims
    in all and the id.
    """

    def choose(rows: list[dict]) -> Iterator[tuple]:
        left = set().union(*[set(r["claims"]) for r in rows])
        roots, n = set(), 0
        while left:
            best = min(rows, key=lambda r: (-len(left & set(r["claims"])), independent and r["root"] in roots, -r["score"], len(set(r["claims"])), r["evidence"]))
            new = left & set(best["claims"])
            n += 1
            yield best["evidence"], n, len(new)
            left -= new
            roots.add(best["root"])

    return _for_each(evidence, key, "evidence long, position int, new_claims int", choose)


def cover_report(evidence: DataFrame, cover: DataFrame, required: DataFrame, key: str = "question") -> DataFrame:
    """``claim_coverage, independent_ratio, redundancy, contradiction_rate, weighted_support`` of each question's cover.

    ``evidence`` also holds ``contradicts``; ``required(question, claims)``.  A question without a cover has coverage 0 (1
    if it requires nothing).
    """
    chosen = evidence.join(cover.select(key, "evidence"), [key, "evidence"], "left_semi").join(required.select(key, F.col("claims").alias("need")), key)
    n = F.size(F.array_intersect("claims", "need"))
    picked = chosen.groupBy(key).agg(
        F.array_distinct(F.flatten(F.collect_list(F.array_intersect("claims", "need")))).alias("covered"), F.countDistinct("root").alias("roots"),
        F.count("*").alias("n"), (F.sum(F.col("score") * n) / F.sum(F.greatest(n, F.lit(1)))).alias("weighted"),
    )
    against = evidence.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("contradicts"))).alias("against"))
    j = required.join(picked, key, "left").join(against, key, "left")
    share = lambda a: F.when(F.size("claims") > 0, F.coalesce(F.size(F.array_intersect("claims", a)), F.lit(0)) / F.size("claims"))
    ratio = F.coalesce(F.col("roots") / F.col("n"), F.lit(0.0))
    return j.select(
        key, F.coalesce(share("covered"), F.lit(0.0) + F.when(F.size("claims") == 0, 1.0).otherwise(0.0)).alias("claim_coverage"), ratio.alias("independent_ratio"),
        F.when(F.col("n") > 0, 1 - ratio).otherwise(0.0).alias("redundancy"), F.coalesce(share("against"), F.lit(0.0)).alias("contradiction_rate"),
        F.coalesce("weighted", F.lit(0.0)).alias("weighted_support"),
    )


def packed_evidence(candidates: DataFrame, budget: int, per_source: int = 3, most_risk: float = 0.5, bonus: float = 0.15, redundancy: float = 0.3) -> DataFrame:
    """Evidence by utility for each token under a budget: ``query_id, doc_id, position, spent``.

    ``candidates(query_id, doc_id, source, score, n_tokens, risk, kin)``: a new source adds ``bonus``, a second of the same
    ``kin`` (null: none) loses ``redundancy``; riskier ones than ``most_risk`` are left out.
    """

    def choose(rows: list[dict]) -> Iterator[tuple]:
        sources, kin, spent, n = {}, set(), 0, 0
        while True:
            fits = [r for r in rows if spent + r["n_tokens"] <= budget and sources.get(r["source"], 0) < per_source]
            if not fits:
                return

            def worth(r: dict) -> tuple:
                u = r["score"] * (1 if r["source"] in sources else 1 + bonus) * (1 - redundancy if r["kin"] in kin else 1)
                return round(u / max(1, r["n_tokens"]), 12), round(u, 12), r["doc_id"]

            best = max(fits, key=worth)
            rows.remove(best)
            spent, n = spent + best["n_tokens"], n + 1
            sources[best["source"]] = sources.get(best["source"], 0) + 1
            if best["kin"] is not None:
                kin.add(best["kin"])
            yield best["doc_id"], n, spent

    return _for_each(candidates.where(F.coalesce(F.col("risk") <= most_risk, F.lit(True))), "query_id", "doc_id long, position int, spent long", choose)


def team_draft(lists: DataFrame, positions: int, seed: str = "") -> DataFrame:
    """Two rankings merged by turns: ``query_id, doc_id, position, team, rank_in_team``.

    ``lists(query_id, team, doc_id, rank)`` with teams a and b.  The team with fewer picks draws its best unused item; a draw
    from the query's hash decides between equal teams.
    """

    def choose(rows: list[dict]) -> Iterator[tuple]:
        query = rows[0]["query_id"]
        ranked = {t: sorted((r["rank"], r["doc_id"]) for r in rows if r["team"] == t) for t in "ab"}
        used, count = set(), {"a": 0, "b": 0}
        for place in range(1, positions + 1):
            free = {t: next((x for x in ranked[t] if x[1] not in used), None) for t in "ab"}
            open_to = [t for t in "ab" if free[t]]
            if not open_to:
                return
            least = min(count[t] for t in open_to)
            able = [t for t in open_to if count[t] == least]
            coin = hashlib.sha256(f"{seed}:{query}:{place}".encode()).digest()[0] % 2
            team = able[coin] if len(able) == 2 else able[0]
            rank, doc = free[team]
            used.add(doc)
            count[team] += 1
            yield doc, place, team, rank

    return _for_each(lists, "query_id", "doc_id long, position int, team string, rank_in_team int", choose)


def labelling_batch(candidates: DataFrame, items: int, most_cost: float, per_group: int, per_task: int) -> DataFrame:
    """Items worth labelling under caps: ``owner, item, position, spent`` by score, uncertainty, cost and id.

    ``candidates(owner, item, task, label_group, score, uncertainty, cost)``: one owner's pool meets in a task.
    """

    def choose(rows: list[dict]) -> Iterator[tuple]:
        groups, tasks, spent, n = {}, {}, 0.0, 0
        for r in sorted(rows, key=lambda r: (-round(r["score"], 12), -r["uncertainty"], r["cost"], r["task"], r["label_group"], r["item"])):
            full = groups.get(r["label_group"], 0) >= per_group or tasks.get(r["task"], 0) >= per_task or spent + r["cost"] > most_cost + 1e-12
            if n < items and not full:
                groups[r["label_group"]] = groups.get(r["label_group"], 0) + 1
                tasks[r["task"]] = tasks.get(r["task"], 0) + 1
                spent, n = spent + r["cost"], n + 1
                yield r["item"], n, spent

    return _for_each(candidates, "owner", "item long, position int, spent double", choose)


def refined_citations(rows: DataFrame, most: int, support: float, sources: int, low: float = 0.3, against: float = 0.5) -> DataFrame:
    """Citations of each claim kept, added and left out: ``claim, chosen, added, removed, combined, status``.

    ``rows(claim, evidence, source, p_support, p_against, quality, cited)``: rows with support of ``low`` and contradiction
    below ``against`` are eligible.  Cited ones come first; others are added, from new sources before old ones, until the
    combined support (1 less the product of misses) and the number of sources suffice.
    """

    def choose(all_rows: list[dict]) -> Iterator[tuple]:
        worth = lambda r: -round(r["p_support"] * r["quality"], 12)
        able = [r for r in all_rows if r["p_support"] >= low and r["p_against"] < against]
        chosen = sorted((r for r in able if r["cited"]), key=lambda r: (worth(r), r["p_against"], r["evidence"]))[:most]
        left = [r for r in able if not r["cited"]]

        def combined() -> float:
            miss = 1.0
            for r in chosen:
                miss *= 1 - r["p_support"] * r["quality"]
            return 1 - miss

        while left and len(chosen) < most and (combined() < support or len({r["source"] for r in chosen}) < sources):
            seen = {r["source"] for r in chosen}
            best = min(left, key=lambda r: (r["source"] in seen, worth(r), r["p_against"], r["evidence"]))
            left.remove(best)
            chosen.append(best)
        kept, cited = [r["evidence"] for r in chosen], sorted(r["evidence"] for r in all_rows if r["cited"])
        enough = combined() >= support and len({r["source"] for r in chosen}) >= sources
        status = "contradicted" if max(r["p_against"] for r in all_rows) >= against else "supported" if enough else "partial" if chosen else "unresolved"
        yield kept, [e for e in kept if e not in cited], [e for e in cited if e not in kept], combined(), status

    return _for_each(rows, "claim", "chosen array<long>, added array<long>, removed array<long>, combined double, status string", choose)
