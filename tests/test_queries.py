"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from remanence.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (float, int)) or hasattr(value, "dtype") and getattr(value, "ndim", 1) == 0:
        return str(value) if isinstance(value, pd.Timestamp) else repr(round(float(value), 6) + 0.0)
    if hasattr(value, "__len__"):
        return str([plain(v) for v in value])
    return str(value)


def table(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_oracle(name, spark, duck):
    got = catalog.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert table(got) == table(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_oracle_runs_and_repeats(name, spark):
    query = catalog.queries()[name]
    first, second = query(spark, SF), query(spark, SF)
    assert first.schema == second.schema
    assert table(first.toPandas()) == table(second.toPandas())
