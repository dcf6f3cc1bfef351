"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import pytest
from broadsheet.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, str(SF))
    got = rows(df.columns, df.collect())
    cursor = oracle.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, str(SF.parent / "sf0.01")).count() > 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__

    assert "doc" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
