"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from textquarry import catalog, catalog_code  # noqa: F401

TABLES = "documents benchmark labels pages conversations events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df, columns):
    fix = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(map(fix, r))) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
