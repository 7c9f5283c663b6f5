"""Measures of retrieval, answers and citations, by query or example."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: precision, recall, hit, reciprocal rank, average precision and nDCG at each k.

    ``ranked(query_id, doc_id, position)``, ``qrels(query_id, doc_id, gain)`` with gains above 0.  One join of ranks
    with judgements, one window inside a query's list, one partially aggregated sum.
    """
    total = qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return _metrics(ranked.join(qrels, ["query_id", "doc_id"], "left"), total, qrels, ks)


def _metrics(hits: DataFrame, total: DataFrame, qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The measures of ``hits(query_id, doc_id, position, gain)``; of ``qrels`` only each query's best are looked at."""
    best = qrels.withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id"))).where(F.col("ideal") <= max(ks))
    credit = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("ideal") + 1)
    best = best.groupBy("query_id").agg(*[F.sum(F.when(F.col("ideal") <= k, credit)).alias(f"idcg_{k}") for k in ks])
    hit = F.coalesce(F.col("gain") > 0, F.lit(False)).cast("int")
    hits = hits.withColumn("hit", hit).withColumn("so_far", F.sum("hit").over(Window.partitionBy("query_id").orderBy("position")))
    dcg = F.when(F.col("hit") == 1, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("position") + 1))
    sums = []
    for k in ks:
        top = F.col("position") <= k
        sums += [
            F.sum(F.when(top, F.col("hit")).otherwise(0)).alias(f"hits_{k}"),
            F.min(F.when(top & (F.col("hit") == 1), F.col("position"))).alias(f"first_{k}"),
            F.sum(F.when(top & (F.col("hit") == 1), F.col("so_far") / F.col("position"))).alias(f"ap_{k}"),
            F.sum(F.when(top, dcg)).alias(f"dcg_{k}"),
        ]
    q = hits.select("query_id").distinct().join(total, "query_id", "left").join(hits.groupBy("query_id").agg(*sums), "query_id").join(best, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.col("query_id"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")]
    for k in ks:
        out += [
            (F.col(f"hits_{k}") / F.lit(float(k))).alias(f"precision_{k}"),
            zero(F.col(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}"),
            (F.col(f"hits_{k}") > 0).cast("double").alias(f"hit_{k}"),
            zero(1.0 / F.col(f"first_{k}")).alias(f"mrr_{k}"),
            zero(F.col(f"ap_{k}") / F.least(F.col("n_relevant"), F.lit(k))).alias(f"map_{k}"),
            zero(F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).alias(f"ndcg_{k}"),
        ]
    return q.select(*out)


# judgements by topic: a query's gold are the documents of its topic in ``pool(topic, doc_id, gain)``, but itself; its pairs
# are never written out, for they are as many as queries times a topic's documents


def judged(ranked: DataFrame, topics: DataFrame, pool: DataFrame) -> DataFrame:
    """``ranked`` with ``gain`` by ``topics(query_id, topic)`` and ``pool``; null where a document is not gold."""
    gold = pool.select("topic", "doc_id", "gain")
    found = ranked.join(topics, "query_id", "left").join(gold, ["topic", "doc_id"], "left").drop("topic")
    return found.withColumn("gain", F.when(F.col("doc_id") != F.col("query_id"), F.col("gain")))


def relevant_counts(topics: DataFrame, pool: DataFrame) -> DataFrame:
    """``query_id, n_relevant`` of the queries that have gold documents."""
    own = topics.join(pool.select("topic", F.col("doc_id").alias("query_id"), F.lit(1).alias("_own")), ["topic", "query_id"], "left")
    n = own.join(pool.groupBy("topic").agg(F.count("*").alias("_n")), "topic")
    return n.select("query_id", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("n_relevant")).where("n_relevant > 0")


def topic_metrics(ranked: DataFrame, topics: DataFrame, pool: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``retrieval_metrics`` with judgements by topic: of a topic only the best documents meet its queries."""
    nth = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("gain"), "doc_id"))
    best = topics.join(pool.withColumn("_n", nth).where(F.col("_n") <= max(ks) + 1), "topic").where("doc_id <> query_id")
    return _metrics(judged(ranked, topics, pool), relevant_counts(topics, pool), best.select("query_id", "doc_id", "gain"), ks)


def topic_report(ranked: DataFrame, topics: DataFrame, pool: DataFrame) -> DataFrame:
    """``selection_report`` with judgements by topic."""
    r = judged(ranked, topics, pool).dropDuplicates(["query_id", "doc_id"]).groupBy("query_id").agg(F.count("gain").alias("_h"), F.count("*").alias("_n"))
    return _shares(r.join(relevant_counts(topics, pool).withColumnRenamed("n_relevant", "_m"), "query_id", "full_outer").na.fill(0, ["_h", "_n", "_m"]))


def rank_biased_overlap(left: DataFrame, right: DataFrame, depth: int = 10, p: float = 0.9) -> DataFrame:
    """Finite RBO of two lists for each query: mean agreement at depths 1 to ``depth`` weighted by p^(d-1)."""
    pairs = left.select("query_id", "doc_id", F.col("position").alias("a")).join(right.select("query_id", "doc_id", F.col("position").alias("b")), ["query_id", "doc_id"])
    meet = pairs.select("query_id", F.greatest("a", "b").alias("at")).where(F.col("at") <= depth)
    # an item that both lists hold by depth m counts at every depth from m on
    weight = lambda d: p ** (d - 1) / d
    tail = F.element_at(F.array(*[F.lit(sum(weight(d) for d in range(m, depth + 1))) for m in range(1, depth + 1)]), F.col("at"))
    norm = sum(p ** (d - 1) for d in range(1, depth + 1))
    scores = meet.groupBy("query_id").agg((F.sum(tail) / norm).alias("rbo"))
    ids = left.select("query_id").unionByName(right.select("query_id")).distinct()
    return ids.join(scores, "query_id", "left").select("query_id", F.coalesce("rbo", F.lit(0.0)).alias("rbo"))


def overlap_counts(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))
    )


def bag_overlap(rows: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """``shared`` of two token arrays for each key as a join of counts: for long texts."""
    left = rows.select(*key, F.explode(a).alias("t")).groupBy(*key, "t").agg(F.count("*").alias("na"))
    right = rows.select(*key, F.explode(b).alias("t")).groupBy(*key, "t").agg(F.count("*").alias("nb"))
    return left.join(right, [*key, "t"]).groupBy(*key).agg(F.sum(F.least("na", "nb")).alias("shared"))


@F.pandas_udf(DoubleType())
def chrf(a: pd.Series, b: pd.Series) -> pd.Series:
    """chrF2 over runs of 1 to 6 characters of two arrays of texts, null where neither has any; runs are counted in the row.

    Precision and recall are means over the lengths of which a side has runs.
    """

    def one(left, right):
        length = [len(t) for t in (*left, *right)]
        room = np.concatenate([np.arange(n, 0, -1) for n in length] or [np.zeros(0, dtype="int64")])  # characters to the end of the text
        first = np.arange(len(room)) < sum(length[: len(left)])
        c = np.frombuffer("".join((*left, *right)).encode("utf-32-le"), dtype="uint32").astype("int64")
        ids, ps, rs = np.zeros(len(c), dtype="int64"), [], []
        for n in range(1, 7):
            at = np.flatnonzero(room >= n)
            if not len(at):
                break
            run = np.unique(ids[at] * 0x110000 + c[at + n - 1], return_inverse=True)[1]  # the run one shorter and its next character
            ids[at] = run
            x, y = (np.bincount(run[side], minlength=run.max() + 1) for side in (first[at], ~first[at]))
            shared = int(np.minimum(x, y).sum())
            ps.append(shared / max(int(x.sum()), 1))
            rs.append(shared / max(int(y.sum()), 1))
        if not ps:
            return None
        p, r = sum(ps) / len(ps), sum(rs) / len(rs)
        return 5 * p * r / (4 * p + r) if p + r > 0 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def f1(shared: Column, a: Column, b: Column) -> Column:
    return F.when((a + b) > 0, 2.0 * shared / (a + b)).otherwise(0.0)


def set_scores(cited: Column, supported: Column, required: Column) -> dict[str, Column]:
    """Citation precision, recall, F1, unsupported rate and coverage of id arrays."""
    good, want = F.size(F.array_intersect(cited, supported)), F.size(F.array_intersect(cited, required))
    n = F.size(F.array_distinct(cited))
    precision = F.when(n > 0, good / n).otherwise(0.0)
    recall = F.when(F.size(required) > 0, want / F.size(F.array_distinct(required))).otherwise(1.0)
    both = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": both, "unsupported": F.when(n > 0, 1 - precision).otherwise(0.0)}


def selection_report(selected: DataFrame, gold: DataFrame, group: str, item: str) -> DataFrame:
    """``precision, recall, f1`` of each group's distinct selected items against its gold ones; 1 where both are empty."""
    a = selected.select(group, item).distinct().withColumn("_a", F.lit(1))
    b = gold.select(group, item).distinct().withColumn("_b", F.lit(1))
    g = a.join(b, [group, item], "full_outer").groupBy(group).agg(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).alias("_h"), F.count("_a").alias("_n"), F.count("_b").alias("_m"))
    return _shares(g)


def _shares(g: DataFrame) -> DataFrame:
    share = lambda n, other: F.when(F.col(n) > 0, F.col("_h") / F.col(n)).when(F.col(other) == 0, 1.0).otherwise(0.0)
    g = g.withColumn("precision", share("_n", "_m")).withColumn("recall", share("_m", "_n"))
    both = F.col("precision") + F.col("recall")
    return g.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).drop("_h", "_n", "_m")


def visual_support(scores: DataFrame, entailed: float = 0.5, contradicted: float = 0.7) -> DataFrame:
    """One row over claims and their visual evidence, ``scores(claim_id, entail, contra, abstained)``.

    A claim is covered if some evidence doesn't abstain; contradicted if its best contradiction reaches the threshold and is
    above its best entailment; else supported at the other threshold; else unsupported.  Rates are over covered claims, null
    without one.
    """
    active = lambda c: F.max(F.when(~F.col("abstained"), F.col(c)))
    claims = scores.groupBy("claim_id").agg(active("entail").alias("e"), active("contra").alias("c"), F.count("*").alias("n"), F.count_if("abstained").alias("out"))
    against = (F.col("c") >= contradicted) & (F.col("c") > F.col("e"))
    share = lambda c: F.avg(F.when(F.col("e").isNotNull(), c.cast("int")))
    backed = ~against & (F.col("e") >= entailed)
    n = F.coalesce(F.sum("n"), F.lit(0))
    return claims.agg(
        F.count("*").alias("claims"), n.alias("evidence"), F.when(n > 0, F.count("e") / F.count("*")).otherwise(0.0).alias("coverage"), F.avg("e").alias("mean_entailment"),
        share(backed).alias("supported"), share(against).alias("contradicted"), share(~against & ~backed).alias("unsupported"),
        F.when(n > 0, F.sum("out") / n).otherwise(0.0).alias("abstained"),
    )
