import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_names():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
