"""Vectors in blocks and judgements by topic against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import evaluation as E
from corpuslens.operators import retrieval as R

VECTORS = [(i, [math.cos(i * i), math.sin(3.0 * i), (i % 5) - 1.5]) for i in range(60)] + [(60 + i, [1.0, 2.0, 3.0]) for i in range(9)] + [(69, [0.0, 0.0, 0.0]), (70, None)]


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


@pytest.mark.parametrize("rows", [8192, 7])
def test_nearest_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").where("vec_id <> 69").repartition(3)
    got = R.nearest(v.where("vec_id % 10 = 0"), v, 12)
    assert not any("NestedLoop" in line or "Cartesian" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines())
    found = {}
    for r in got.orderBy("query_id", "position").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    vectors = {r.vec_id: r.embedding for r in v.collect()}
    for q in (i for i in vectors if i % 10 == 0):
        x = vectors[q]
        all_ = [(i, None if x is None or y is None else round(cosine(x, y), 9)) for i, y in vectors.items() if i != q]
        want = sorted(all_, key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:12]
        assert [i for i, _ in found[q]] == [i for i, _ in want]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want], abs=2e-9) or q == 70


def test_vector_of_length_zero_is_first_as_not_a_number(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    first = R.nearest(v.where("vec_id = 10"), v, 1).first()
    assert first.vec_id == 69 and math.isnan(first.similarity)


@pytest.mark.parametrize("rows", [8192, 7])
def test_late_interaction(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    v = spark.createDataFrame([x for x in VECTORS if x[0] not in (69, 70)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 6 = 0").select(F.col("vec_id").alias("qv"), (F.col("vec_id") % 4).alias("q"), F.col("embedding").alias("qe"))
    docs = v.select((F.col("vec_id") % 9).alias("d"), F.col("embedding").alias("de"))
    got = {(r.q, r.d): r.score for r in R.late_interaction(q, docs, ["d"]).collect()}
    asked, known = q.collect(), docs.collect()
    want = {}
    for name in {r.q for r in asked}:
        for d in range(9):
            best = [max(cosine(r.qe, x.de) for x in known if x.d == d) for r in asked if r.q == name]
            want[name, d] = sum(best) / len(best)
    assert got == pytest.approx(want)


def test_judgements_by_topic_are_those_of_the_pairs(spark):
    ranked = spark.createDataFrame([(q, d, p + 1) for q, docs in {0: [3, 5, 8], 1: [0, 3, 2], 2: [9, 1, 0], 12: [4, 5, 6]}.items() for p, d in enumerate(docs)], "query_id long, doc_id long, position int")
    topics = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (12, None)], "query_id long, topic string")
    pool = spark.createDataFrame([(d, "ab"[d % 2], 1 + d % 3) for d in range(12)] + [(2, "c", 3)], "doc_id long, topic string, gain long")
    pairs = topics.join(pool, "topic").where("doc_id <> query_id").select("query_id", "doc_id", "gain")
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(E.topic_metrics(ranked, topics, pool)) == rows(E.retrieval_metrics(ranked, pairs))
    assert rows(E.topic_report(ranked, topics, pool)) == rows(E.selection_report(ranked, pairs, "query_id", "doc_id"))
    assert rows(E.judged(ranked, topics, pool)) == rows(ranked.join(pairs, ["query_id", "doc_id"], "left"))
