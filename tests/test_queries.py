"""Every registered query against its SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from catalogue.contracts import TABLES
from catalogue.duckdb_sql import SQL
from catalogue.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns in name order."""
    def text(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float):
            return repr(float(value))
        if hasattr(value, "item"):
            value = value.item()
        return repr(value) if isinstance(value, float) else str(value)

    columns = sorted(pdf.columns)
    return sorted(tuple(text(v) for v in row)
                  for row in pdf[columns].astype(object).itertuples(index=False, name=None))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1500
