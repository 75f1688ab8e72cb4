"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from siftwork.plans import catalog
from siftwork.session import TABLES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
    assert len(a) == len(b) and a == b, [x for x in zip(a, b) if x[0] != x[1]][:2]
    assert len(a) > 0
