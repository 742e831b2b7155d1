"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from orrery import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = rows_of(got.collect(), got.columns)
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows == rows_of(want.fetchall(), columns)
    else:
        assert rows
