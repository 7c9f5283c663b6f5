"""Every registered query of the core against its SQL, at the smallest scale."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(v) for v in value])
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return str(round(float(value), 6) + 0.0)
    if isinstance(value, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(value))
    return str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    expected = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
