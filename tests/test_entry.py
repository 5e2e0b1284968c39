"""Every query with a counterpart gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from wayfare.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        return None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 6)

    return sorted(([tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)]), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(entry_points.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
