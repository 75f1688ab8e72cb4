"""Merges into touched buckets only: rows, files, versions, batches that come twice."""

import random

from pyspark.sql import functions as F

from siftwork.operators.keyed import KeyedTable
from siftwork.session import shared_dir

SCHEMA = "k long, at long, title string, note string"


def rows(t):
    return sorted((tuple(r) for r in t.read().select("k", "at", "title", "note").collect()), key=repr)


def make(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_random_merges_against_a_dictionary(spark):
    t, want, rng = KeyedTable(spark, shared_dir(spark), ["k"], 8), {}, random.Random(2)
    for _ in range(4):
        batch = [(rng.choice([None, *range(12)]), rng.randrange(50), rng.choice("xyz"), None) for _ in range(10)]
        t.merge(make(spark, batch), ["at", "title"])
        for r in sorted(batch, key=lambda r: (r[1], r[2])):
            if r[0] not in want or r[1:3] >= want[r[0]][1:3]:
                want[r[0]] = r
        assert rows(t) == sorted(want.values(), key=repr)
    gone = [3, None, 99]
    t.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
    assert rows(t) == sorted((r for k, r in want.items() if k not in gone), key=repr)
    asked = spark.createDataFrame([(1,), (2,), (99,)], "k long")
    assert {r.k for r in t.get(asked).collect()} == {k for k in want if k in (1, 2)}


def test_only_touched_buckets_are_written(spark):
    t = KeyedTable(spark, shared_dir(spark), ["k"], 16)
    t.merge(make(spark, [(i, 0, "a", None) for i in range(400)]))
    before = set(t.read().inputFiles())
    t.merge(make(spark, [(7, 1, "b", None), (8, 1, "b", None)]))
    after = set(t.read().inputFiles())
    assert len(before) == 16 and len(after) == 16 and len(after - before) <= 2 and len(before & after) >= 14
    assert t.read().count() == 400 and {r.k for r in t.read().where("title = 'b'").collect()} == {7, 8}
    old = KeyedTable(spark, t.path, ["k"], 16)  # a reader of the version before still finds its files
    assert old.versions.read(1).count() == 17
    t.clean()
    assert t.versions.children(f"{t.path}/versions") == ["2"] and t.read().count() == 400


def test_partial_rows_and_defaults(spark):
    t = KeyedTable(spark, shared_dir(spark), ["k"], 4)
    t.merge(spark.createDataFrame([(1, "one")], "k long, title string"), defaults={"note": F.lit("not yet evaluated"), "at": F.lit(0)})
    t.merge(spark.createDataFrame([(1, 5), (2, 6)], "k long, at long"), partial=True, defaults={"note": F.lit("new")})
    assert rows(t) == [(1, 5, "one", "not yet evaluated"), (2, 6, None, "new")]
    t.merge(spark.createDataFrame([(1, "whole")], "k long, title string"))
    assert rows(t) == [(1, None, "whole", None), (2, 6, None, "new")]


def test_a_batch_that_comes_twice(spark):
    t = KeyedTable(spark, shared_dir(spark), ["k"], 4)
    assert t.merge(make(spark, [(1, 1, "a", None)]), number=0) == 1
    assert t.merge(make(spark, [(1, 2, "b", None)]), number=1) == 2
    assert t.merge(make(spark, [(1, 1, "a", None)]), number=0) == 2
    assert rows(t) == [(1, 2, "b", None)]
    t.delete(spark.createDataFrame([(1,)], "k long"))
    assert t.merge(make(spark, [(1, 1, "a", None)]), number=1) == 3
    assert t.read(SCHEMA).count() == 0 and t.get(make(spark, [(1, 1, "a", None)])).count() == 0 if t._held()[1] else True
