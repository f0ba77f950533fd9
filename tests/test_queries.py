"""Every query of the engine's own operators against its SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from lodestream.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool | int | str | dt.datetime):
        return x
    return round(float(x), 9) if isinstance(x, float) else str(x)


def rows(found, columns):
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr), columns


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect(), columns)
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    want = rows(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall(), columns)
    assert got == want


def test_names():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
