"""Every registered query runs, and equals its SQL where it has one."""

import decimal
import glob
import os

import duckdb
import pytest
from pyspark.sql import Row

import __spark_entry__ as entry
from lorecast.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    """Integers stay integers, so that large ids are told apart."""
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 6)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, Row):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = got.collect()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(found, got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
