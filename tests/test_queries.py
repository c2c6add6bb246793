"""Every registered query against its DuckDB oracle on the smallest table set."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from pricelab.plans.queries import QUERIES
from tests.conftest import SF_SMALL

TABLES = ["lineitem", "orders", "part", "customer"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def _rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False, name=None):
        out.append(tuple(None if (v is None or v is pd.NaT or (isinstance(v, float) and v != v)) else
                         (pd.Timestamp(v).to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r))
    return sorted(out, key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    du = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(du.columns)
    assert len(sp) == len(du)
    assert _rows(sp) == _rows(du)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "category"
