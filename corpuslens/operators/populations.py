"""Maintained populations against what is there, logged episodes, and routes of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("kind", "name")
#: What must agree, and the finding where it doesn't, first that differs.
SIGNATURE = (("generation", "generation_drift"), ("profile", "profile_drift"), ("schema", "schema_drift"), ("source", "source_drift"))
FALL_BACK = ("corpus-hybrid", "corpus-sparse", "dense", "scholarly", "web")


def population_plan(desired: DataFrame, physical: DataFrame, aliases: DataFrame, now: Column, grace: float = 86_400.0) -> DataFrame:
    """Findings and the action of each, nothing is changed: ``kind, name, status, physical_id, action, expected_id, expected_revision``.

    ``desired(kind, name, generation, profile, schema, source, n, population)`` has one row a key, ``aliases(kind, name,
    physical_id, revision)`` at most one; ``physical(kind, name, physical_id, state, generation, profile, schema, source, n,
    population, created_at, protected, in_flight)`` any number, times in seconds.  A ready population that agrees in all is
    chosen, the aliased one first, else the least id; else one that is being built; else the target is to be populated.
    Other populations that agree with no target are orphans, live while an alias names them, protected while marked, in
    flight or younger than ``grace``.  A population that agrees but isn't chosen has no finding.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    wanted = desired.select(*KEY, *[F.col(c).alias(f"d_{c}") for c, _ in SIGNATURE], F.col("n").alias("d_n"), F.col("population").alias("d_population"), F.lit(True).alias("maintained"))
    bound = aliases.select(*KEY, F.col("physical_id").alias("expected_id"), F.col("revision").alias("expected_revision"))
    p = physical.join(wanted, list(KEY), "left").join(bound, list(KEY), "left")
    agrees = F.col("maintained").isNotNull() & (F.col("state") == "ready") & same("n", "d_n")
    for c, _ in SIGNATURE:
        agrees = agrees & same(c, f"d_{c}")
    p = p.withColumn("exact", agrees).withColumn("building", (F.col("state") == "building") & (same("population", "d_population") | F.col("in_flight")))
    drift = {name: F.max(~same(c, f"d_{c}")).alias(name) for c, name in SIGNATURE}
    found = p.where("maintained").groupBy(*KEY).agg(
        F.min(F.when(F.col("exact"), F.col("physical_id"))).alias("ready_id"),
        F.max(F.col("exact") & same("physical_id", "expected_id")).alias("bound"),
        F.min(F.when(F.col("building"), F.col("physical_id"))).alias("building_id"),
        F.max(F.col("state") == "failed").alias("failed_population"),
        *drift.values(),
    )
    status = F.when(F.col("bound"), "healthy").when(F.col("ready_id").isNotNull(), F.when(F.col("expected_id").isNull(), "alias_missing").otherwise("alias_stale"))
    status = status.when(F.col("building_id").isNotNull(), "population_in_flight").when(F.col("failed_population").isNull(), "missing").when(F.col("failed_population"), "failed_population")
    for name in drift:
        status = status.when(F.col(name), name)
    status = status.otherwise("count_drift")
    chosen = F.when(F.col("bound"), F.col("expected_id")).otherwise(F.coalesce("ready_id", "building_id"))
    binds = F.col("status").isin("alias_missing", "alias_stale")
    targets = wanted.select(*KEY).join(found, list(KEY), "left").join(bound, list(KEY), "left").withColumn("status", status).select(
        *KEY, "status", chosen.alias("physical_id"),
        F.when(binds, "bind_alias").when(~F.col("status").isin("healthy", "population_in_flight"), "populate").alias("action"),
        F.when(binds, F.col("expected_id")).alias("expected_id"), F.when(binds, F.coalesce("expected_revision", F.lit(0))).cast("long").alias("expected_revision"),
    )
    taken = found.where("ready_id is null").select(F.col("building_id").alias("taken_id")).where("taken_id is not null")
    named = bound.where("expected_id is not null").select(F.col("expected_id").alias("named_id")).distinct()
    rest = physical.join(p.where("exact").select("physical_id"), "physical_id", "left_anti")
    rest = rest.join(taken, rest.physical_id == taken.taken_id, "left_anti").join(named, rest.physical_id == named.named_id, "left")
    safe = F.col("protected") | F.col("in_flight") | ((now - F.col("created_at")) < grace)
    kind = F.when(F.col("named_id").isNotNull(), "live_orphan").when(safe, "protected_orphan").otherwise("orphan_candidate")
    orphans = rest.withColumn("status", kind).select(
        *KEY, "status", "physical_id", F.when(F.col("status") == "orphan_candidate", "record_orphan_candidate").alias("action"),
        F.lit(None).cast("string").alias("expected_id"), F.lit(None).cast("long").alias("expected_revision"),
    )
    return targets.unionByName(orphans)


def episode_report(steps: DataFrame, outcomes: DataFrame, least_gain: float = 0.0) -> DataFrame:
    """One row of a retrieving policy's actions, costs and calibration over logged episodes.

    ``steps(episode, step, action, oracle_action, probability, gain, cost, latency, tokens)``; ``outcomes(episode, supported,
    contradicted, abstained, utility, oracle_utility)``, one an episode, also for those without a step.  Rates without a
    denominator are null, means of gain and cost without a retrieval 0.  Repeated steps or outcomes, and steps without an
    outcome, are refused.
    """
    retrieves, known = F.col("action") == "retrieve", F.col("oracle_action").isNotNull()
    right = known & (F.col("action") == F.col("oracle_action"))
    n = lambda c: F.count_if(c)
    total = lambda c, x: F.sum(F.when(c, x))
    each = steps.groupBy("episode").agg(
        F.count("*").alias("steps"), F.count_distinct("step").alias("places"), n(known).alias("labelled"), n(right).alias("right"),
        n(retrieves & right).alias("hits"), n(retrieves & known).alias("asked"), n(F.col("oracle_action") == "retrieve").alias("due"),
        n(retrieves).alias("retrievals"), n(retrieves & (F.col("gain") > least_gain)).alias("useful"),
        total(retrieves, F.col("gain")).alias("gain"), total(retrieves, F.col("cost")).alias("cost"), F.sum("latency").alias("latency"), F.sum("tokens").alias("tokens"),
        total(known, F.pow(F.col("probability") - right.cast("int"), 2)).alias("brier"),
    )
    ends = outcomes.groupBy("episode").agg(
        F.count("*").alias("ends"), F.max(F.col("supported").cast("int")).alias("supported"), F.max(F.col("contradicted").cast("int")).alias("contradicted"),
        F.max(F.col("abstained").cast("int")).alias("abstained"), F.max("utility").alias("utility"), F.max("oracle_utility").alias("oracle_utility"),
    )
    odd = F.col("ends").isNull() | (F.col("ends") > 1) | (F.col("places") < F.col("steps"))
    both = ends.join(each, "episode", "full_outer").withColumn("ends", F.when(odd, F.raise_error(F.lit("steps and outcomes must be unique, and each step's episode have an outcome")).cast("long")).otherwise(F.col("ends")))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda a, b: F.when(s(b) > 0, s(a) / s(b))
    gap = F.greatest(F.lit(0.0), F.col("oracle_utility") - F.col("utility"))
    return both.agg(
        F.sum("ends").alias("episodes"), s("steps").alias("steps"), rate("right", "labelled").alias("action_accuracy"),
        rate("hits", "asked").alias("retrieve_precision"), rate("hits", "due").alias("retrieve_recall"),
        F.avg(F.coalesce("retrievals", F.lit(0))).alias("mean_retrievals"), rate("useful", "retrievals").alias("useful_rate"),
        (1 - rate("useful", "retrievals")).alias("unnecessary_rate"), F.coalesce(rate("gain", "retrievals"), F.lit(0.0)).alias("mean_gain"),
        F.coalesce(rate("cost", "retrievals"), F.lit(0.0)).alias("mean_cost"), rate("latency", "steps").alias("mean_latency"), rate("tokens", "steps").alias("mean_tokens"),
        F.avg("supported").alias("supported_rate"), F.avg("contradicted").alias("contradiction_rate"), F.avg("abstained").alias("abstention_rate"),
        F.avg("utility").alias("mean_utility"), F.avg(F.when(F.col("oracle_utility").isNotNull(), gap)).alias("mean_regret"), rate("brier", "labelled").alias("brier"),
    )


def preferred_route(scope: Column, domain: Column, exact: Column, temporal: Column, comparative: Column, citing: Column, uploaded: Column) -> Column:
    """The route that a query's scope and analysis ask for; ``uploaded`` is the first search mode over uploaded documents."""
    scholarly = (domain == "scholarly") | citing
    mixed = F.when(exact, "corpus-sparse").when(temporal, "web").when(~comparative & scholarly, "scholarly").otherwise("corpus-hybrid")
    return F.when(scope == "uploaded", uploaded).when(scope == "public", F.when(scholarly, "scholarly").otherwise("web")).otherwise(mixed)


def route_cases(runs: DataFrame, cost_weight: float = 0.05, latency_weight: float = 0.05) -> DataFrame:
    """``case, selected_route, best_route, success, best_success, correct, regret, cost, latency`` of each case.

    ``runs(case, route, preferred, sufficiency, enough, hits, relevant, cost, latency, failed)`` has a row for each route that ran; a
    preferred route that didn't run falls back in the order of FALL_BACK.
    """
    r = route_scores(runs, cost_weight, latency_weight)
    order = F.when(F.col("route") == F.col("preferred"), 0)
    for i, route in enumerate(FALL_BACK):
        order = order.when(F.col("route") == route, i + 1)
    row = F.struct("route", "utility", "success", "cost", "latency")
    rank = F.struct("utility", "quality", -F.col("cost"), -F.col("latency"), "route")
    both = r.groupBy("case").agg(F.min_by(row, order).alias("own"), F.max_by(row, rank).alias("best"))
    return both.select(
        "case", F.col("own.route").alias("selected_route"), F.col("best.route").alias("best_route"), F.col("own.success").alias("success"),
        F.col("best.success").alias("best_success"), (F.col("own.route") == F.col("best.route")).alias("correct"),
        F.round(F.greatest(F.lit(0.0), F.col("best.utility") - F.col("own.utility")), 9).alias("regret"), F.col("own.cost").alias("cost"), F.col("own.latency").alias("latency"),
    )


def route_scores(runs: DataFrame, cost_weight: float = 0.05, latency_weight: float = 0.05) -> DataFrame:
    """``runs`` with ``quality``, ``utility`` and ``success``: 0.65 sufficiency and 0.35 share of what is relevant, less what it took."""
    share = F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(F.col("sufficiency"))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * F.col("sufficiency") + 0.35 * share))
    took = cost_weight * F.least(F.col("cost") / 1_000, F.lit(1.0)) + latency_weight * F.least(F.col("latency") / 10_000, F.lit(1.0))
    success = ~F.col("failed") & F.when(F.col("relevant") > 0, F.col("hits") > 0).otherwise(F.col("enough"))
    return runs.withColumns({"quality": F.round(quality, 9), "utility": F.round(quality - took, 9), "success": success})


def route_report(cases: DataFrame) -> DataFrame:
    """Success of the selected and of the best routes, accuracy of the selection, mean regret, cost and latency, in one row."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return cases.agg(
        F.count("*").alias("cases"), share("success").alias("selected_success"), share("best_success").alias("oracle_success"), share("correct").alias("accuracy"),
        share("regret").alias("mean_regret"), share("cost").alias("mean_cost"), share("latency").alias("mean_latency"),
    )
