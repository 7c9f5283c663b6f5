"""Matches of claims, evidence over sets of document graphs, adjustment sets of causal graphs and records along a network."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpuslens.operators.lineage import cut, small

# one-to-one matches of claims

#: Characters of a span's bucket: spans that overlap share one.
BUCKET = 256


def claim_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of tokens; two empty bags are equal."""
    times = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))
    shared = F.aggregate(F.transform(F.array_distinct(a), lambda t: F.least(times(a, t), times(b, t))), F.lit(0), lambda s, n: s + n)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / both)


@F.pandas_udf(DoubleType())
def _bag_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """``bag_f1`` in one pass over the tokens, for texts of any length."""

    def one(x, y):
        if x is None or y is None:
            return None
        both = len(x) + len(y)
        return 2.0 * (Counter(x) & Counter(y)).total() / both if both else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def _side(df: DataFrame, id_: str, p: str, *columns: str) -> DataFrame:
    return df.select("doc", id_, *[F.col(c).alias(p + c) for c in columns])


def _overlap() -> tuple[Column, Column]:
    """Characters that two spans share, and the part of their common extent (null where they lie in two sections)."""
    shared = F.greatest(F.least("g_end", "p_end") - F.greatest("g_start", "p_start"), F.lit(0))
    span = F.greatest("g_end", "p_end") - F.least("g_start", "p_start")
    return shared, F.when((F.col("g_section") == F.col("p_section")) & (span > 0), shared / span).otherwise(0.0)


def _scored(pairs: DataFrame) -> DataFrame:
    same = lambda c: F.coalesce((F.col("g_" + c) == F.col("p_" + c)).cast("int"), F.lit(0))
    return pairs.select(
        "doc", "gold_id", "proposal_id", same("evidence").alias("exact_evidence"), _overlap()[1].alias("iou"), _bag_f1(claim_tokens(F.col("g_claim")), claim_tokens(F.col("p_claim"))).alias("f1"),
        same("type").alias("same_type"), same("modality").alias("same_modality"), (same("section") * same("start") * same("end")).alias("exact_span"),
    )


WHOLE = ("section", "start", "end", "evidence", "claim", "type", "modality")


def near_claims(gold: DataFrame, proposals: DataFrame, least_iou: float, least_f1: float) -> DataFrame:
    """Pairs of one document whose spans overlap, by ``least_iou`` with words that agree by ``least_f1`` or with one evidence, scored.

    Spans meet without their texts, in buckets of BUCKET characters, in the first bucket that both reach.
    """
    if not 0 < least_iou <= 1:
        raise ValueError("spans must overlap: least_iou lies above 0, up to 1")
    bucket = lambda c: F.floor(c / BUCKET)
    spans = lambda df, id_, p: _side(df, id_, p, "section", "start", "end", "evidence").select("*", F.col(p + "section").alias("s"), F.explode(F.sequence(bucket(F.col(p + "start")), bucket(F.greatest(F.col(p + "end") - 1, F.col(p + "start"))))).alias("bucket"))
    shared, iou = _overlap()
    first = F.col("bucket") == bucket(F.greatest("g_start", "p_start"))
    met = spans(gold, "gold_id", "g_").join(spans(proposals, "proposal_id", "p_"), ["doc", "s", "bucket"])
    met = met.where(first & (shared > 0) & ((iou >= least_iou) | (F.col("g_evidence") == F.col("p_evidence")))).drop("s", "bucket")
    met = met.join(_side(gold, "gold_id", "g_", "claim", "type", "modality"), ["doc", "gold_id"]).join(_side(proposals, "proposal_id", "p_", "claim", "type", "modality"), ["doc", "proposal_id"])
    return _scored(met).where((F.col("exact_evidence") == 1) | (F.col("f1") >= least_f1))


def apart_claims(gold: DataFrame, proposals: DataFrame, order: list[Column]) -> DataFrame | None:
    """Matches of claims that share their evidence where no two such claims overlap; None without any.

    Where all claims of an evidence are alike, only ids tell them apart, and the walk takes them in the order of their
    ids: the n-th meets the n-th, and copies are not expanded into pairs.
    """
    keys = ["doc", "evidence"]
    common = cut(gold.where("evidence is not null").select(keys).distinct().join(proposals.select(keys).distinct(), keys))
    if common.isEmpty():
        return None
    kind = F.struct("claim", "type", "modality")
    some = lambda df, id_: cut(df.select("doc", id_, *WHOLE).join(small(common), keys))
    g, p = some(gold, "gold_id"), some(proposals, "proposal_id")
    alike = lambda df: df.groupBy(keys).agg(F.min(kind).eqNullSafe(F.max(kind)).alias("alike")).where("alike").select(keys)
    plain = small(cut(alike(g).join(alike(p), keys)))
    nth = lambda df, id_: df.join(plain, keys, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(keys).orderBy(id_)))
    side = lambda df, id_, p_, *more: df.select("doc", "evidence", id_, *more, *[F.col(c).alias(p_ + c) for c in WHOLE])
    zipped = side(nth(g, "gold_id"), "gold_id", "g_", "n").join(side(nth(p, "proposal_id"), "proposal_id", "p_", "n"), [*keys, "n"])
    mixed = side(g.join(plain, keys, "left_anti"), "gold_id", "g_").join(side(p.join(plain, keys, "left_anti"), "proposal_id", "p_"), keys)
    return cut(_scored(zipped)).unionByName(one_to_one(_scored(mixed), "gold_id", "proposal_id", ["doc"], order))


def one_to_one(pairs: DataFrame, left: str, right: str, by: list[str], order: list[Column]) -> DataFrame:
    """The pairs that a walk in ``order`` keeps when it skips whatever is taken already, without such a walk.

    In each round the pairs that come first for both of their ends are kept, and all pairs with a taken end go: no pair
    before them could have taken either end.  ``order`` must leave no ties within ``by``.
    """
    open_, kept = cut(pairs), None
    while not open_.isEmpty():
        first = lambda end: F.row_number().over(Window.partitionBy(*by, end).orderBy(*order))
        taken = cut(open_.withColumn("_l", first(left)).withColumn("_r", first(right)).where("_l = 1 and _r = 1").drop("_l", "_r"))
        kept = taken if kept is None else kept.unionByName(taken)
        open_ = cut(open_.join(taken.select(*by, left), [*by, left], "left_anti").join(taken.select(*by, right), [*by, right], "left_anti"))
    return pairs.limit(0) if kept is None else kept


def match_claims(gold: DataFrame, proposals: DataFrame, least_iou: float = 0.5, least_f1: float = 0.5) -> DataFrame:
    """One-to-one matches of ``proposals(doc, proposal_id, section, start, end, evidence, claim, type, modality)`` to ``gold``.

    Best first within a document: shared evidence, overlap, words, type, modality, then ids.
    """
    order = [*[F.desc(c) for c in ("exact_evidence", "iou", "f1", "same_type", "same_modality")], F.col("gold_id"), F.col("proposal_id")]
    walk = lambda pairs: one_to_one(pairs, "gold_id", "proposal_id", ["doc"], order)
    open_ = lambda df, end, taken: df.join(taken.select("doc", end), ["doc", end], "left_anti")
    near = cut(near_claims(gold, proposals, least_iou, least_f1))
    # pairs with one evidence come before all others, those that overlap before those that don't
    taken = walk(near.where("exact_evidence = 1"))
    apart = apart_claims(open_(gold, "gold_id", taken), open_(proposals, "proposal_id", taken), order)
    taken = taken if apart is None else taken.unionByName(apart)
    return taken.unionByName(walk(open_(open_(near.where("exact_evidence = 0"), "gold_id", taken), "proposal_id", taken)))


def claim_report(gold: DataFrame, proposals: DataFrame, matches: DataFrame) -> DataFrame:
    """``doc, n_gold, n_proposals, n_matched, precision, recall, f1`` and the means over matches of each document."""
    count = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    mean = lambda c, name: F.avg(F.col(c).cast("double")).alias(name)
    m = matches.groupBy("doc").agg(
        F.count("*").alias("n_matched"), mean("iou", "mean_iou"), mean("f1", "mean_token_f1"), mean("exact_evidence", "exact_evidence_rate"), mean("exact_span", "exact_span_rate"),
        mean("same_type", "type_accuracy"), mean("same_modality", "modality_accuracy"),
    )
    all_ = count(gold, "n_gold").join(count(proposals, "n_proposals"), "doc", "full_outer").join(m, "doc", "left").na.fill(0)
    share = lambda n: F.when(F.col(n) > 0, F.col("n_matched") / F.col(n)).otherwise(0.0)
    p, r = share("n_proposals"), share("n_gold")
    return all_.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


# evidence over a set of document graphs

ORIGINS = ("lexical", "cross_document", "within_document")


#: Rows of seeds that a task holds before it drops those that can't start.
SEEDS = 1 << 18


def _first_seeds(seeds: DataFrame, per_document: int, most_seeds: int) -> DataFrame:
    """``seeds`` without rows that ``most_seeds`` rows of their own task come before, at most ``per_document`` of a document.

    Of all rows a document's i-th best comes no later than its i-th best in one task, so as many come before such a row in
    the end, and it can't start.  Rows with a null or NaN stay.
    """
    documents = [("query", "ascending"), ("doc", "ascending"), ("score", "descending"), ("node", "ascending")]
    queries = [("query", "ascending"), ("score", "descending"), ("doc", "ascending"), ("node", "ascending")]

    def nth(t: pa.Table, keys: list[str]) -> np.ndarray:
        """The place of each row in its run of equal keys."""
        new = np.ones(len(t), bool)
        new[1:] = np.any([pc.not_equal(t[k][1:], t[k][:-1]).to_numpy() for k in keys], axis=0)
        at = np.arange(len(t))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    def pruned(t: pa.Table) -> pa.Table:
        t = t.sort_by(documents)
        t = t.filter(pa.array(nth(t, ["query", "doc"]) < per_document)).sort_by(queries)
        return t.filter(pa.array(nth(t, ["query"]) < most_seeds))

    def run(batches):
        held, rows, last = [], 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            plain = pc.and_(pc.is_finite(t["score"]), pc.and_(pc.and_(pc.is_valid(t["query"]), pc.is_valid(t["doc"])), pc.is_valid(t["node"])))
            plain = pc.fill_null(plain, False)
            yield from t.filter(pc.invert(plain)).to_batches()
            t = t.filter(plain)
            if last is not None:  # what is below the last row that a full query holds
                at = pc.index_in(t["query"], last["query"].combine_chunks())
                t = t.filter(pc.fill_null(pc.greater_equal(t["score"], pc.take(last["score"], at)), True))
            held.append(t)
            rows += len(t)
            if rows >= SEEDS:
                t = pruned(pa.concat_tables(held))
                if len(t) > SEEDS // 2:  # of many queries
                    yield from t.to_batches(max_chunksize=10_000)
                    t = t.slice(0, 0)
                full = t.filter(pa.array(nth(t, ["query"]) == most_seeds - 1))
                held, rows, last = [t], len(t), full
        if rows:
            yield from pruned(pa.concat_tables(held)).to_batches(max_chunksize=10_000)

    return seeds.mapInArrow(run, seeds.schema)


def graph_set_evidence(
    seeds: DataFrame, within: DataFrame, across: DataFrame, per_document: int = 10, most_seeds: int = 100, within_per_seed: int = 3, depth: int = 2, across_per_seed: int = 20, top: int = 200,
) -> DataFrame:
    """``query, doc, node, score, origin, seed, lineage, position``: the best row of each node that a query's seeds reach.

    ``seeds(query, doc, node, score)`` are lexical hits: the best ``per_document`` of a document and ``most_seeds`` of a query
    start.  ``within(src, dst, edge, weight)`` leads to a seed's own document (the strongest edges, score times weight times
    0.7), ``across(src, dst, edge, weight)`` to other documents over up to ``depth`` edges (score times weight times 0.8 an
    edge).  A seed visits a node once, at its least depth, by the best edge there (ties: the smallest edge), and its
    ``across_per_seed`` first nodes by depth and score count.  ``doc`` of what is reached is that of its ``dst_doc`` column.
    Of several rows of a node the best score wins, then the origin in the order of ORIGINS, then the seed; ``lineage``
    lists the edges from the seed.  Fronts hold what the bounds leave, so no table grows with the graph's paths.
    """
    rank = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = [F.desc("score"), F.col("node")]
    start = _first_seeds(seeds.select("query", "doc", "node", "score"), per_document, most_seeds)
    start = start.withColumn("_n", rank(["query", "doc"], *best)).where(F.col("_n") <= per_document)
    start = start.withColumn("_n", rank(["query"], F.desc("score"), "doc", "node")).where(F.col("_n") <= most_seeds).drop("_n")
    no_edges = F.array().cast("array<string>")
    start = cut(start.select("query", F.col("node").alias("seed"), "doc", "node", "score", F.lit(0).alias("depth"), no_edges.alias("lineage")))

    def step(front: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
        e = edges.select(F.col("src").alias("node"), "dst", F.col("dst_doc"), F.col("edge").cast("string").alias("edge"), "weight")
        return front.join(e, "node").select(
            "query", "seed", F.col("dst_doc").alias("doc"), F.col("dst").alias("node"), (F.col("score") * F.col("weight") * factor).alias("score"), (F.col("depth") + 1).alias("depth"),
            F.array_append("lineage", F.col("edge")).alias("lineage"), "edge", "weight",
        )

    near = step(start, within, 0.7).withColumn("_n", rank(["query", "seed"], F.desc("weight"), "edge")).where(F.col("_n") <= within_per_seed)
    found = [start.withColumn("origin", F.lit("lexical")), near.select(*start.columns).withColumn("origin", F.lit("within_document"))]
    visited, front = start, start
    for _ in range(depth):
        new = step(front, across, 0.8).join(visited.select("query", "seed", "node"), ["query", "seed", "node"], "left_anti")
        front = cut(new.withColumn("_n", rank(["query", "seed", "node"], F.desc("score"), "edge")).where("_n = 1").select(*start.columns))
        visited = visited.unionByName(front)
    far = visited.where("depth > 0").withColumn("_n", rank(["query", "seed"], "depth", F.desc("score"), "node")).where(F.col("_n") <= across_per_seed).drop("_n")
    found.append(far.withColumn("origin", F.lit("cross_document")))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    order = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    one = every.withColumn("_n", rank(["query", "node"], F.desc("score"), order, "seed", F.array_join("lineage", "\x1f"))).where("_n = 1")
    placed = one.withColumn("position", rank(["query"], F.desc("score"), order, "doc", "node")).where(F.col("position") <= top)
    return placed.select("query", "doc", "node", "score", "origin", "seed", "lineage", "position")


# adjustment sets of causal graphs


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``question, node`` of all nodes that ``edges(question, src, dst)`` lead to from ``start(question, node)``, itself included."""
    front = cut(start.select("question", "node").distinct())
    seen = front
    while not front.isEmpty():
        step = front.join(edges, (front.question == edges.question) & (front.node == edges.src)).select(front.question, F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["question", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def adjustment_sets(nodes: DataFrame, edges: DataFrame, questions: DataFrame) -> DataFrame:
    """``question, valid, blocked, descendants, unknown`` for ``questions(question, dag, exposure, outcome, adjustment)``.

    ``edges(dag, src, dst)`` are directed and acyclic, ``nodes(dag, node)`` the variables.  A set is valid if it names known
    variables only, none that the exposure leads to, and closes every back-door path: with the exposure's own edges taken
    away, no trail from it to the outcome stays open.  Trails are followed as states (node, came from a child or not): one
    passes a node outside the set unless two arrows meet there, and turns at such a meeting if the set holds it or one of
    its descendants.  Every question walks its own graph, all of them in the same rounds; unknown variables leave it open.
    """
    q = questions.select("question", "dag", "exposure", "outcome", F.array_distinct(F.coalesce("adjustment", F.array().cast("array<string>"))).alias("z"))
    q = cut(q)
    known = nodes.groupBy("dag").agg(F.collect_set("node").alias("names"))
    mine = cut(q.join(edges, "dag").select("question", "src", "dst", "exposure", "z"))
    back = mine.where("src <> exposure")
    at = lambda c: F.col(c).alias("node")
    # the exposure's children and all that they lead to
    below = reached(mine.where("src = exposure").select("question", at("dst")), mine.select("question", "src", "dst"))
    above = reached(q.select("question", F.explode("z").alias("node")), back.select("question", F.col("dst").alias("src"), F.col("src").alias("dst")))
    state = lambda c, up: F.struct(F.col(c).alias("n"), F.lit(up).alias("up"))
    outside = lambda c: ~F.array_contains("z", F.col(c))
    move = lambda df, a, b: df.select("question", a.alias("src"), b.alias("dst"))
    meets = back.join(above.withColumnRenamed("node", "dst"), ["question", "dst"], "left_semi")
    moves = move(back.where(outside("dst")), state("dst", True), state("src", True))
    moves = moves.unionByName(move(back.where(outside("src")), state("src", True), state("dst", False)))
    moves = moves.unionByName(move(back.where(outside("src")), state("src", False), state("dst", False)))
    moves = cut(moves.unionByName(move(meets, state("dst", False), state("src", True))))
    seen = reached(q.where(outside("exposure")).select("question", state("exposure", True).alias("node")), moves)
    open_ = seen.select("question", F.col("node.n").alias("outcome")).distinct().join(q.where(outside("outcome")).select("question", "outcome"), ["question", "outcome"], "left_semi")
    bad = below.groupBy("question").agg(F.collect_set("node").alias("below"))
    rows = q.join(known, "dag", "left").join(bad, "question", "left").join(open_.select("question", F.lit(True).alias("open")), "question", "left")
    none = F.array().cast("array<string>")
    unknown = F.array_sort(F.array_except(F.array_union(F.array("exposure", "outcome"), F.col("z")), F.coalesce("names", none)))
    descendants = F.array_sort(F.array_intersect("z", F.coalesce("below", none)))
    rows = rows.select("question", unknown.alias("unknown"), descendants.alias("descendants"), F.coalesce("open", F.lit(False)).alias("open"))
    blocked = (F.size("unknown") == 0) & ~F.col("open")
    return rows.select("question", (blocked & (F.size("descendants") == 0)).alias("valid"), blocked.alias("blocked"), "descendants", "unknown")


# records along a network


def travel_seconds(edges: DataFrame, targets: DataFrame, most: int = 32) -> DataFrame:
    """``target, node, seconds``: the least travel time from each node upstream of ``targets(target)`` over ``edges(src, dst, seconds)``.

    Fronts hold only nodes whose time got less, so a round costs what changed; rounds end with them or after ``most`` edges.
    An edge without a time leads nowhere.
    """
    front = cut(targets.select("target", F.col("target").alias("node"), F.lit(0.0).alias("seconds")).distinct())
    best = front
    for _ in range(most):
        up = front.join(edges.where("seconds is not null").select(F.col("dst").alias("node"), "src", F.col("seconds").alias("more")), "node")
        step = up.groupBy("target", F.col("src").alias("node")).agg(F.min(F.col("seconds") + F.col("more")).alias("seconds"))
        was = best.select("target", "node", F.col("seconds").alias("was"))
        front = cut(step.join(was, ["target", "node"], "left").where("was is null or seconds < was").select("target", "node", "seconds"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("target", "node").agg(F.min("seconds").alias("seconds")))
    return best


def shifted_records(travel: DataFrame, windows: DataFrame, records: DataFrame, width: float) -> DataFrame:
    """``target, record, node, seconds, at`` of the records that reach a target within its window.

    A record of ``records(record, node, at)`` counts if ``at`` plus its node's travel time lies between ``start`` and ``end`` of
    ``windows(target, start, end)``.  Shifted windows and records meet by node and by time slots of ``width``.
    """
    shifted = travel.join(windows, "target").select("target", "node", "seconds", (F.col("start") - F.col("seconds")).alias("first"), (F.col("end") - F.col("seconds")).alias("last"))
    slots = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("slot")
    r = records.select("record", "node", "at", F.floor(F.col("at") / width).alias("slot"))
    return shifted.where("first <= last").select("*", slots).join(r, ["node", "slot"]).where("at between first and last").select("target", "record", "node", "seconds", "at")


def unresolved_records(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """``record, reason`` of records that name no node, or one that isn't in ``nodes(node)``."""
    lost = records.join(nodes.select("node").distinct(), "node", "left_anti")
    return lost.select("record", F.when(F.col("node").isNull(), "no_node").otherwise("unknown_node").alias("reason"))


# counter-evidence


def counter_evidence(claims: DataFrame, contradictions: DataFrame, evidence: DataFrame, most: int = 2, limit: int = 10) -> DataFrame:
    """``claim, kind, item, root, position``: nodes linked to a claim by contradiction, and tagged evidence with its roots.

    Nodes lie within ``most`` edges of ``contradictions(src, dst)``, forwards or backwards along all of them, in the order
    of their names; evidence of ``evidence(item, root, score, contradicts)`` names the claim, best first (ties: root, item).
    Both stop at ``limit``.
    """
    asked = claims.select(F.col("claim").alias("question"), F.col("claim").alias("node")).distinct()
    found = None
    for a, b in (("src", "dst"), ("dst", "src")):
        edges, front, seen = contradictions.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct(), asked, asked
        for _ in range(most):
            step = front.join(edges, front.node == edges._from).select("question", F.col("_to").alias("node")).distinct()
            front = cut(step.join(seen, ["question", "node"], "left_anti"))
            seen = seen.unionByName(front)
        found = seen if found is None else found.unionByName(seen)
    rank = lambda *order: F.row_number().over(Window.partitionBy("claim").orderBy(*order))
    nodes = found.where("node <> question").distinct().select(F.col("question").alias("claim"), F.lit("node").alias("kind"), F.col("node").cast("string").alias("item"), F.lit(None).cast("string").alias("root"), "node")
    nodes = nodes.withColumn("position", rank("node")).where(F.col("position") <= limit).drop("node")
    tagged = evidence.select("item", "root", "score", F.explode(F.array_distinct("contradicts")).alias("claim")).join(claims.select("claim").distinct(), "claim")
    tagged = tagged.withColumn("position", rank(F.desc("score"), "root", "item")).where(F.col("position") <= limit)
    return nodes.unionByName(tagged.select("claim", F.lit("evidence").alias("kind"), F.col("item").cast("string").alias("item"), F.col("root").cast("string").alias("root"), "position"))
