"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from folioflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr(r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
