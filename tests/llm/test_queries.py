"""The queries that SQL can state, on the smallest tables."""

import duckdb
import pytest

from siftwork.llm import queries as llm
from siftwork.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    got = llm.queries()[name](spark, SF)
    want = c.sql(llm.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(k) for k in got.columns]
    plain = lambda x: round(float(x), 9) if isinstance(x, (int, float)) else x
    a = sorted(repr([plain(x) for x in r]) for r in got.collect())
    b = sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
    assert a == b and a


def test_names():
    names = [k for k in llm.queries() if k.startswith("op")]
    assert [int(k[2:].split("_")[0]) for k in names] == list(range(1, 14))
