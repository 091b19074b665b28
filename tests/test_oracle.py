"""Every market query with an oracle returns what DuckDB returns."""

from __future__ import annotations

import glob

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF

from tapeweave.plans.queries import ORACLE_SQL, QUERIES


def rows(df: pd.DataFrame) -> list[str]:
    df = df.reindex(sorted(df.columns), axis=1)
    text = lambda x: "~" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else f"{float(x):.5f}" if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted("|".join(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("name", "most"), [("b01_simulated_trades", 10_000)])
def test_other_queries_give_rows(spark, name, most):
    assert 0 < len(QUERIES[name](spark, SF).collect()) <= most
