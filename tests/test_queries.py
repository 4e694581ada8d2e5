"""Every query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from barloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(v + 0.0) if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else repr(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)


def test_every_query_runs(spark, data):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, data).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert "d9_islands" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
