"""Node search scores equal nodes and queries once, with the rows that all pairs give."""

import math

from corpuslens.operators import linking as L
from pyspark.sql import functions as F


def brute(queries, nodes, top):
    out = set()
    for q, text in queries:
        terms = list(dict.fromkeys(text.split()))
        rows = []
        for node, type_, label, body, risk in nodes:
            words = (label + " " + body).lower().split()
            held = [t for t in terms if t in words]
            if held and risk <= 0.45:
                s = sum(1 + math.log1p(words.count(t)) + 1.5 * (t in label.lower().split()) for t in held) + len(held) / len(terms)
                s += 2.0 * (" ".join(terms) == label.lower()) + 0.25 * (type_ == "A")
                rows.append((-round(s * (1 - 0.5 * risk), 9), type_, label.lower(), node))
        out |= {(q, r[3], -r[0], i + 1) for i, r in enumerate(sorted(rows)[:top])}
    return out


def test_copies_of_nodes_and_queries(spark, monkeypatch):
    labels = ["Red ring", "red bolt", "blue ring", "blue plate", "red red"]
    nodes = [(i, "AB"[i % 2], labels[i % 5], ["x1", "ring x2", "bolt"][i % 3], [0.1, 0.3, 0.6][i // 7 % 3]) for i in range(900)]
    queries = [(i, ["red ring", "blue", "bolt red", "none", "ring red blue"][i % 5]) for i in range(60)]
    written, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    q = spark.createDataFrame(queries, "query_id long, text string")
    n = spark.createDataFrame(nodes, "node long, type string, label string, text string, risk double")
    got = L.search_nodes(q, n, top=7, favoured=("A",), exclude=F.col("risk") > 0.45, penalty=0.5).collect()
    assert {(r.query_id, r.node, round(r.score, 6), r.position) for r in got} == {(a, b, round(s, 6), p) for a, b, s, p in brute(queries, nodes, 7)}
    assert len(got) == len(brute(queries, nodes, 7))
    assert written and written[0].count() <= 7 * 2 * 5 * 3 * 2
