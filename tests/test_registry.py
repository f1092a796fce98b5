"""Every registered query against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from almanac.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(x):
    if pd.isna(x):
        return None
    if isinstance(x, datetime.datetime):
        return x.date()
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x.is_integer() else x  # a column with nulls comes as floats


def rows(frame, columns):
    return sorted(repr([plain(x) for x in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), db.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)
