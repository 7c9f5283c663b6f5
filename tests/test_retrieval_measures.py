"""Measures of rankings by vectors make no more rows than the tables hold and equal their SQL, with ties, copies and unjudged queries."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpuslens.plans import catalog

MEASURES = ("g43_robustness_gates", "g2_recall", "g5_average_precision", "g6_ndcg", "g3_hit_rate", "g7_retrieval_evaluation")


def made_rows(plan):
    """Largest number of rows that a step of an executed plan made."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        below = [plan.finalPhysicalPlan()]
    elif kind.endswith("QueryStage"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    metric = plan.metrics().get("numOutputRows")
    return max([metric.get().value() if metric.isDefined() else 0, *map(made_rows, below)])


@pytest.mark.parametrize("name", MEASURES)
def test_rows_made_and_sql(spark, tmp_path, name):
    n, rng = 1500, np.random.default_rng(11)
    vectors = rng.normal(0, 1, (n, 6)).astype("float32")
    vectors[700:760] = vectors[100]  # copies of a query, so ties
    labels = rng.choice([0, 1, 2], n, p=[0.6, 0.39, 0.01]).tolist()
    labels[200], labels[300] = None, 3  # no label, a label of its own
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(zip(vectors, labels))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    run = catalog.queries()[name](spark, str(tmp_path))
    got = run.toPandas()
    assert made_rows(run._jdf.queryExecution().executedPlan()) <= n  # all pairs are 15 times as many
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).df()
    if "query_id" in got:
        got, want = (x.sort_values("query_id", ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got.map(lambda x: list(x) if isinstance(x, np.ndarray) else x), want.map(lambda x: list(x) if isinstance(x, np.ndarray) else x), check_dtype=False, atol=1e-9)
