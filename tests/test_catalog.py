"""Every catalogue query against its DuckDB SQL on sf0.001 (the driver's check, smaller)."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from ruleframe.plans.catalog import QUERIES
from ruleframe.plans.oracle import ORACLE

from conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


def _norm(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        vals = []
        for v in r:
            if v is None or v is pd.NA or (isinstance(v, float) and v != v):
                vals.append(None)
                continue
            if hasattr(v, "item"):
                v = v.item()
            if isinstance(v, float) and v.is_integer():
                v = int(v)
            vals.append(v)
        out.append(tuple(vals))
    return sorted(out, key=repr)


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "overall" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    dd = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert _norm(sp) == _norm(dd)
