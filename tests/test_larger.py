"""Queries against their SQL on small tables with the keys and ties that larger ones have."""

import duckdb
from test_oracles import rows

from siftwork.plans import catalog


def same(spark, tmp_path, name, tables):
    """The query's rows, after a look that the SQL has the same."""
    db = duckdb.connect()
    for table, sql in tables.items():
        db.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = rows(df.columns, df.collect())
    want = db.sql(catalog.oracle_sql()[name])
    assert got == rows(want.columns, want.fetchall())
    return got


def test_catalogue_with_numbers_of_six_digits(spark, tmp_path):
    line = "SELECT unnest([1, 2, 50000, 50001, 100004, 60000, 25000]) AS l_suppkey, unnest(range(7)) AS l_orderkey, 1 AS l_linenumber"
    got = same(spark, tmp_path, "catalogue_matches", {"supplier": "SELECT unnest([2, 4, 100001, 100002, 100005, 120000, 20001, 10000]) AS s_suppkey", "lineitem": line})
    assert len(got) == 6


LINE = "l_orderkey, l_partkey, l_suppkey, CAST(0.05 AS DECIMAL(15, 2)) AS l_discount, CAST(0.02 AS DECIMAL(15, 2)) AS l_tax, CAST(10 AS DECIMAL(15, 2)) AS l_quantity, DATE '2000-01-01' AS l_shipdate"


def test_equal_connections_and_none_of_two_hops(spark, tmp_path):
    pairs = "SELECT unnest(range(16)) AS l_orderkey, unnest([1, 10, 100, 11, 2, 20, 101, 3, 1, 10, 100, 11, 2, 20, 101, 3]) AS l_partkey, unnest([1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2]) AS l_suppkey"
    got = same(spark, tmp_path, "connection_paths", {"lineitem": f"SELECT {LINE} FROM ({pairs})"})
    assert len(got) == 5 and "s1>p100>s2" in got[0]
    (tmp_path / "far").mkdir()
    chain = "SELECT unnest(range(4)) AS l_orderkey, unnest([1, 1, 2, 2]) AS l_partkey, unnest([1, 3, 3, 2]) AS l_suppkey"
    assert same(spark, tmp_path / "far", "connection_paths", {"lineitem": f"SELECT {LINE} FROM ({chain})"}) == []
