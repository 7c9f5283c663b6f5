"""Trust, retention, splits and other rules over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import INJECTION


def injection_signals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, signal, n, severity`` of each instruction-like pattern found."""
    each = F.array(*[F.struct(F.lit(k).alias("signal"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for k, p in INJECTION])
    rows = docs.select(key, F.explode(each).alias("s")).select(key, "s.*").where("n > 0")
    return rows.withColumn("severity", F.round(F.least(F.lit(1.0), 0.55 + 0.15 * F.col("n")), 6))


def content_trust(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, signals, worst, action`` by the number and severity of signals."""
    found = injection_signals(docs, key, text).groupBy(key).agg(F.count("*").alias("signals"), F.max("severity").alias("worst"))
    worst, n = F.coalesce("worst", F.lit(0.0)), F.coalesce("signals", F.lit(0))
    action = F.when(worst >= 0.85, "quarantine").when(n >= 2, "review").when(n == 1, "allow_with_warning").otherwise("allow_as_evidence")
    return docs.select(key).join(found, key, "left").select(key, n.alias("signals"), worst.alias("worst"), action.alias("action"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def resolve_entities(mentions: DataFrame, aliases: DataFrame, threshold: float = 0.85, margin: float = 0.05) -> DataFrame:
    """``mention, entity, how, score`` of the distinct ``mentions(mention)`` among ``aliases(entity, alias)``.

    An exact alias decides (the first entity by name where several have it).  Else the entity with the best token Jaccard
    over its aliases is taken if it reaches ``threshold`` and leads the next entity by ``margin``: ``how`` is exact,
    similar, ambiguous or unknown.  Mentions and aliases meet by an equi-join on their tokens, partially summed.
    """
    m, al = mentions.select("mention").where("mention is not null").distinct(), aliases.select("entity", "alias").distinct()
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    exact = m.join(al, F.col("mention") == F.col("alias")).groupBy("mention").agg(F.min("entity").alias("known"))
    rest = m.join(exact, "mention", "left_anti").withColumn("tm", tokens(F.col("mention")))
    each = al.withColumn("ta", tokens(F.col("alias"))).select("entity", "alias", F.size("ta").alias("na"), F.explode("ta").alias("t"))
    hits = rest.select("mention", F.size("tm").alias("nm"), F.explode("tm").alias("t")).join(each, "t")
    shared = hits.groupBy("mention", "nm", "entity", "alias", "na").agg(F.count("*").alias("k"))
    scored = shared.groupBy("mention", "entity").agg(F.max(F.col("k") / (F.col("nm") + F.col("na") - F.col("k"))).alias("score"))
    order = Window.partitionBy("mention").orderBy(F.desc(F.round("score", 9)), "entity")
    first = scored.select("mention", "entity", "score", F.lead("score").over(order).alias("second"), F.row_number().over(order).alias("nth")).where("nth = 1")
    gap = F.col("score") - F.coalesce("second", F.lit(0.0))
    how = F.when(F.col("known").isNotNull(), "exact").when(F.coalesce("score", F.lit(0.0)) < threshold, "unknown").when(gap < margin, "ambiguous").otherwise("similar")
    found = m.join(exact, "mention", "left").join(first, "mention", "left").withColumn("how", how)
    return found.select("mention", F.when(F.col("how") == "similar", F.col("entity")).otherwise(F.col("known")).alias("entity"), "how", F.when(F.col("how") == "exact", 1.0).otherwise(F.col("score")).alias("score"))


def guarded_states(events: DataFrame, key: str, state: str, order: list[str], allowed: list[tuple]) -> DataFrame:
    """``key, state, n_moves, n_illegal``: the latest state, and moves from the state before that ``allowed`` doesn't list.

    ``allowed`` holds (before, after); a first move has no state before it.
    """
    w = Window.partitionBy(key)
    e = events.select(key, F.col(state).alias("state"), F.lag(state).over(w.orderBy(*order)).alias("before"), F.row_number().over(w.orderBy(*[F.desc(o) for o in order])).alias("nth"))
    good = [F.col("before").eqNullSafe(F.lit(b)) & (F.col("state") == a) for b, a in allowed]
    legal = reduce(lambda x, y: x | y, good)
    return e.groupBy(key).agg(F.max(F.when(F.col("nth") == 1, F.col("state"))).alias("state"), F.count("*").alias("n_moves"), F.count(F.when(~legal, 1)).alias("n_illegal"))
