"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as driver
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    mine = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    a, b = (df[cols].sort_values(cols).reset_index(drop=True) for df in (mine, theirs))
    assert len(a) == len(b) > 0
    assert [str(t) for t in a.dtypes] == [str(t) for t in b.dtypes]
    assert (a.astype(str) == b.astype(str)).all().all()


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
