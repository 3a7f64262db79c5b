"""Every registered query of the engine runs; those with SQL give what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from clademill.plans import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else float(x) if hasattr(x, "__float__") else str(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    assert len(found.columns)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert rows(found) == rows(duck.execute(sql).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
