"""Odd values on which queries once gave other rows than their SQL."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpuslens.operators import assess as A
from corpuslens.plans import catalog


def test_snippet_starts_after_a_line_end(spark):
    text = "a" * 100 + " word\n" + "b" * 179 + " needle " + "c " * 300
    got = spark.createDataFrame([(text,)], "text string").select(A.snippet(F.col("text"), F.array(F.lit("needle"))).alias("s")).first().s
    assert got.startswith("b" * 179 + " needle")


def test_norms_just_above_one_are_clipped(spark, tmp_path):
    a = np.random.default_rng(5).uniform(0.3, 0.9, 2_000_000).astype("float32")
    b = np.sqrt(1 - a.astype("float64") ** 2).astype("float32")
    norm = np.sqrt(a.astype("float64") ** 2 + b.astype("float64") ** 2)
    near = np.flatnonzero(np.abs(norm - 1) < 4e-13)
    assert (norm[near] > 1).any()
    rows = [(i, [float(a[n]), float(b[n]), *[0.0] * 62], 0) for i, n in enumerate(near)] + [(1000 + i, [1.0] + [0.0] * 63, 0) for i in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["h38_clipped_aggregate"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    pd.testing.assert_frame_equal(got, con.execute(catalog.oracle_sql()["h38_clipped_aggregate"]).df(), check_dtype=False)
    assert got.clipped[0] == (norm[near] > 1).sum()
