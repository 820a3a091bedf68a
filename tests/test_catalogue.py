"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from fringeline.plans import catalogue
from fringeline.plans.templates import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    tidy = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    other = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    kinds = dict(zip(other.columns, map(str, other.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(other.columns, other.fetchall())


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
