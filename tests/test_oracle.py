"""Every registered engine query against its DuckDB twin."""

import duckdb
import pytest

from quarry.plans import catalogue

TABLES = "documents pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    twin = duck.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(twin.columns, twin.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 60
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
