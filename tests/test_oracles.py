"""Every query with an oracle gives the same rows as DuckDB over the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from genospark.plans.oracles import ORACLES
from genospark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


def rows(frame):
    cell = lambda x: "" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{float(x) + 0.0:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else str(x)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, con):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
