"""Rows that queries shuffle: in step with their input, not with the pairs that they look at."""

import math

import pytest
from pyspark.sql import functions as F

from siftwork.operators import context as cx
from siftwork.operators import graph as g


@pytest.fixture
def joins(spark):
    """The session with joins that shuffle, as large tables have them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark, make):
    """(the rows of make(), how many rows were written to shuffles for them)"""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    got = make().collect()
    return got, sum(n for k, n in written().items() if k not in before)


def test_related_shuffles_lists_of_far_ends(joins):
    n = 30
    edges = joins.range(n * n).select(F.concat(F.lit("s"), F.floor(F.col("id") / n)).alias("source"), F.concat(F.lit("p"), F.col("id") % n).alias("target"), F.lit("x").alias("predicate"), F.lit(0.5).alias("confidence"), (F.col("id") % 7 + 1).alias("weight"), F.lit(0).alias("stated"))
    nodes = edges.select(F.col("source").alias("node"), F.lit("actor").alias("type")).union(edges.select("target", F.lit("tool"))).distinct()
    got, rows = shuffled(joins, lambda: cx.related(edges, nodes, edges.select(F.col("source").alias("seed"))))
    assert len(got) == n * 10
    assert rows < 25 * n * n  # paths of two steps: n * n * n


def test_similar_shuffles_lists_of_nodes(joins):
    """Lines and points of a plane: any two lines meet in one point or none."""
    p = 31
    x = F.col("id") % p
    m, c = F.floor(F.col("id") / p) % p, F.floor(F.col("id") / p**2)
    links = joins.range(p**3).select(F.concat(m, F.lit("_"), c).alias("node"), (x * p + (m * x + c) % p).alias("feature"))
    got, rows = shuffled(joins, lambda: g.similar(links, 1, 0.0))
    assert len(got) == p**3 * (p - 1) // 2 and {r.shared for r in got} == {1}
    assert rows - 2 * len(got) < 10 * p**3  # pairs found are told their nodes' weights: two shuffles


def test_long_lists_meet_by_blocks(spark, monkeypatch):
    """Features of more nodes than a list holds, for all nodes and for some."""
    monkeypatch.setattr(g, "BLOCK", 3)
    links = spark.createDataFrame([(f"n{i}", f) for i in range(10) for f in range(5) if (i + f) % (f + 1) == 0 or i % 3 == f % 3], "node string, feature int")
    has = {}
    for r in links.collect():
        has.setdefault(r.node, set()).add(r.feature)
    df = {f: sum(f in v for v in has.values()) for f in range(5)}
    w = lambda fs: sum(math.log(1 + len(has) / df[f]) for f in fs)
    want = {(a, b): (len(has[a] & has[b]), math.floor(w(has[a] & has[b]) / w(has[a] | has[b]) * 100 + 0.5) / 100) for a in has for b in has if a < b and len(has[a] & has[b]) >= 2}
    got = {(r.a, r.b): (r.shared, r.score) for r in g.similar(links, 2, 0.0).collect()}
    assert got == want and max(df.values()) > 6
    seeds = spark.createDataFrame([("n4",), ("n1",), ("n9",)], "seed string")
    some = {(r.seed, r.node): r.shared for r in cx.similar(links, seeds, 99, 2, 0.0).collect()}
    assert some == {p: v[0] for (a, b), v in want.items() for p in ((a, b), (b, a)) if p[0] in ("n1", "n4", "n9")}


def test_facts_of_reports_shuffle_once(joins):
    """Each report names eight actors and eight tools of its own: its facts go to their edges, and nowhere before."""
    reports, k = 200, 8
    rows = joins.range(reports * k).select(F.floor(F.col("id") / k).alias("report"), F.col("id"))
    named = rows.select("report", F.concat(F.lit("a"), "id").alias("node"), F.lit("actor").alias("kind"), F.lit(0.8).alias("confidence")).union(rows.select("report", F.concat(F.lit("t"), "id"), F.lit("tool"), F.lit(0.5)))
    stated = joins.createDataFrame([("a0", "uses", "t1", 0, 0.2), ("x", "uses", "y", 999, 0.7)], "source string, predicate string, target string, report long, confidence double")
    f = g.co_reported(named, stated, {("actor", "tool"): ("uses", 0.6)}).withColumn("seen", F.lit(None).cast("date"))
    got, rows = shuffled(joins, lambda: g.edges(f))
    assert len(got) == reports * k * k + 1
    found = {(r.source, r.target): (r.confidence, r.weight, r.stated) for r in got}
    assert (found["a0", "t1"], found["a0", "t2"], found["x", "y"]) == ((0.5, 1, 1), (0.3, 1, 0), (0.7, 1, 1))
    assert rows < 1.5 * len(got)
