"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lorekeep import plans


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return con


def canonical(df):
    def text(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str(v)
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else f"{v:.6g}"
        return str(v)

    rows = df[sorted(df.columns)].map(text).values.tolist()
    return sorted(df.columns), sorted(rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, sf, name):
    found = plans.QUERIES[name](spark, sf).toPandas()
    expected = duck.execute(plans.ORACLES[name]).df()
    assert canonical(found) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
