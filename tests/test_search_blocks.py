"""Searches keep a query's best rows block by block, with the rows that all pairs give."""

import math
from collections import Counter

import pytest
from corpuslens.functions import text as X
from corpuslens.operators import retrieval as R


@pytest.mark.parametrize("rows", [60, 65_536])
def test_best_rows_of_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "BLOCK_TERMS", rows)
    texts = [f"alpha{i % 3} beta{i % 7} common gamma{i % 5} common" for i in range(105)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    asked = {7: "alpha1 beta2 common", 9: "gamma3 gamma3 beta6", 11: "common"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    kept, products = [], R._products
    monkeypatch.setattr(R, "_products", lambda q, p, k, **kw: (kept.append((products(q, p, k, **kw), k)), kept[-1][0])[1])

    n, bags = 210, [Counter(t.split()) for t in texts * 2]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in df}
    weigh = lambda b: {w: (1 + math.log(c)) * idf[w] for w, c in b.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    length = sum(sum(b.values()) for b in bags) / n
    for q, text in asked.items():
        mine = weigh(Counter(text.split()))
        cos = {i: round(sum(x * weigh(b).get(w, 0) for w, x in mine.items()) / norm(mine) / norm(weigh(b)), 9) for i, b in enumerate(bags) if set(b) & set(mine)}
        best = sorted(cos.items(), key=lambda x: (-x[1], -x[0]))[:5]
        got = R.search(R.query_terms(queries.where(f"query_id = {q}")), docs, top_k=5).orderBy("position").collect()
        assert [(r.doc_id, r.cosine) for r in got] == [(i, pytest.approx(c)) for i, c in best]
        raw = {i: sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / length)) for w, c in Counter(text.split()).items() if w in b) for i, b in enumerate(bags) if set(b) & set(text.split())}
        top = max(raw.values())
        best = sorted(raw, key=lambda i: (-round(raw[i] / top, 9), -i))[:5]
        got = R.top_k(R.bm25(R.query_terms(queries.where(f"query_id = {q}"), tokens=X.field_tokens), docs, top=5), 5).orderBy("position").collect()
        assert [r.doc_id for r in got] == best and [r.raw for r in got] == [pytest.approx(raw[i]) for i in best]
    for df_, k in kept:
        assert df_.count() <= k * 3 * 20
