"""Every query of the catalogue runs on the small tables, and equals its SQL twin there."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from treeline import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(f"{float(v):.15g}")
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    order = [[x[0] for x in result.description].index(c) for c in columns]
    want = sorted((plain(tuple(r[i] for i in order)) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
