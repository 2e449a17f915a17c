"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from riskloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 3) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_same_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(want.fetchall(), columns)
