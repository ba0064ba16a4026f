"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodeframe.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if not isinstance(v, (list, dict)) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, small, duck, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
