"""What a graph says about entities: links by type, what is related and similar, activity, known against seen.

Every function takes a table of seeds and answers for all of them in one job.
Joins start from the seeds; lists in the results have a length that is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.operators import graph as g
from siftwork.session import pieces


def _round(c: Column, digits: int) -> Column:
    return F.floor(F.round(c * 10**digits, 6) + 0.5) / 10**digits


def _best(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with r, their number."""
    return df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("r") <= most)


def links(e: DataFrame, nodes: DataFrame, seeds: DataFrame, per_type: int = 8) -> DataFrame:
    """(seed, type, total, items): a seed's edges by the type of the other end, the
    strongest per_type of each. e: edges with weight, confidence and stated; nodes:
    (node, type); seeds: (seed)."""
    s = e.withColumn("s", g.strength(F.col("weight"), F.col("confidence"), F.col("stated")))
    near = g.both_ways(s).join(seeds.select(F.col("seed").alias("node")).distinct(), "node").join(nodes.select(F.col("node").alias("peer"), "type"), "peer")
    total = near.groupBy("node", "type").agg(F.count("*").alias("total"))
    top = _best(near, ["node", "type"], [F.desc("s"), F.col("peer"), F.col("predicate")], per_type)
    item = F.struct("r", "peer", "predicate", _round(F.col("s"), 6).alias("strength"))
    items = top.groupBy("node", "type").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("r")).alias("items"))
    return items.join(total, ["node", "type"]).select(F.col("node").alias("seed"), "type", "total", "items")


def related(e: DataFrame, nodes: DataFrame, seeds: DataFrame, first_hops: int = 60, most: int = 10, hidden: str = "indicator", alike: str = "technique") -> DataFrame:
    """(seed, rank, peer, score, via): nodes two steps from a seed and not one. A path
    adds the product of its strengths over log2(2 + the middle's edges); scores are relative
    to the seed's best; via: the three middles that add most. Only a seed's strongest
    first_hops edges are followed; nodes of the hidden type are passed over, and two
    of the type alike don't count as related."""
    s = e.withColumn("s", g.strength(F.col("weight"), F.col("confidence"), F.col("stated")))
    ends = g.both_ways(s).select("node", "peer", "s", "predicate").join(nodes.select(F.col("node").alias("peer"), F.col("type").alias("peer_type")), "peer", "left")
    # One shuffle by node serves seeds and middles; an end's number deals long lists into blocks.
    order = W.partitionBy("node").orderBy(F.col("peer_type").isNull(), F.desc("s"), "peer", "predicate")
    ends = ends.withColumn("r", F.row_number().over(order)).withColumn("block", F.floor(F.col("r") / g.BLOCK))
    near = ends.join(seeds.select(F.col("seed").alias("node")).distinct(), "node", "left_semi").where("peer_type IS NOT NULL")
    first = near.where((F.col("r") <= first_hops) & (F.col("peer_type") != hidden))
    own = nodes.select(F.col("node").alias("seed"), F.col("type").alias("seed_type"))
    one = first.groupBy(F.col("node").alias("seed"), F.col("peer").alias("mid")).agg(F.sum("s").alias("s1")).join(own, "seed")
    # Far ends go to a seed as lists of a middle, not as rows: its sums need no further shuffle.
    of_mid = ends.join(first.select(F.col("peer").alias("node")).distinct(), "node", "left_semi")
    seen = F.when(F.col("peer_type") != hidden, F.struct("peer", F.col("s").alias("s2")))
    far = of_mid.groupBy(F.col("node").alias("mid"), "block", F.coalesce(F.col("peer_type") == alike, F.lit(False)).alias("_alike")).agg(F.collect_list(seen).alias("far"), F.count("*").alias("k"))
    far = far.withColumn("damp", 1 / F.log2(2 + F.sum("k").over(W.partitionBy("mid")))).where(F.size("far") > 0)
    lists = one.join(far, "mid").where(~F.col("_alike") | (F.col("seed_type") != alike)).select("seed", "mid", (F.col("s1") * F.col("damp")).alias("f"), F.col("far.peer").alias("peers"), F.col("far.s2").alias("s2"))
    # What is direct comes along as a list without a middle.
    direct = near.groupBy(F.col("node").alias("seed"), "block").agg(F.collect_set("peer").alias("peers"))
    direct = direct.select("seed", F.lit(None).cast(lists.schema["mid"].dataType).alias("mid"), F.lit(None).cast("double").alias("f"), "peers", F.transform("peers", lambda x: F.lit(None).cast("double")).alias("s2"))
    met = lists.unionByName(direct).repartition(pieces(e), "seed")
    each = met.select("seed", "mid", "f", F.explode(F.arrays_zip("peers", "s2")).alias("x")).select("seed", "mid", F.col("x.peers").alias("peer"), (F.col("f") * F.col("x.s2")).alias("x")).where(F.col("peer") != F.col("seed"))
    sums = each.groupBy("seed", "peer").agg(F.sum("x").alias("x"), F.count_if(F.col("mid").isNull()).alias("near")).where("near = 0").drop("near")
    sums = sums.withColumn("score", _round(F.col("x") / F.max("x").over(W.partitionBy("seed")), 2))
    top = _best(sums, ["seed"], [F.desc(F.round("x", 9)), F.col("peer")], most).withColumnRenamed("r", "rank")
    wanted = top.groupBy("seed").agg(F.collect_list("peer").alias("wanted"))  # most peers a seed
    kept = F.filter(F.arrays_zip("peers", "s2"), lambda x: F.array_contains("wanted", x["peers"]))
    paths = met.where("mid IS NOT NULL").join(wanted, "seed").select("seed", "mid", "f", F.explode(kept).alias("x"))
    paths = paths.groupBy("seed", F.col("x.peers").alias("peer"), "mid").agg(F.sum(F.col("f") * F.col("x.s2")).alias("x"))
    via = _best(paths, ["seed", "peer"], [F.desc(F.round("x", 9)), F.col("mid")], 3).groupBy("seed", "peer").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "mid"))), lambda v: v["mid"]).alias("via"))
    return top.join(via, ["seed", "peer"]).select("seed", "rank", "peer", "score", "via")


def similar(pairs: DataFrame, seeds: DataFrame, most: int = 6, least_shared: int = 2, least_score: float = 0.08) -> DataFrame:
    """(seed, rank, node, shared, score): weighted Jaccard of seeds with all other
    nodes, a feature's weight being ln(1 + N / df). pairs: (node, feature)."""
    out = g.alike(pairs, seeds.select(F.col("seed").alias("node")).distinct(), least_shared, least_score)
    # A pair of two seeds is met once and told to both.
    ends = F.array(F.struct(F.col("a").alias("seed"), F.col("b").alias("node")), F.when(F.col("both"), F.struct(F.col("b").alias("seed"), F.col("a").alias("node"))))
    out = out.select("shared", "score", F.explode(F.array_compact(ends)).alias("x")).select("x.seed", "x.node", "shared", _round(F.col("score"), 2).alias("score"))
    return _best(out, ["seed"], [F.desc("score"), F.desc("shared"), F.col("node")], most).select("seed", F.col("r").alias("rank"), "node", "shared", "score")


def activity(facts: DataFrame, seeds: DataFrame, now: str, months: int = 12) -> DataFrame:
    """(seed, activity, last90, prior90, trend) of seeds: reports by month, the last months
    with any, oldest first. facts: (node, report, seen)."""
    mine = facts.join(seeds.select(F.col("seed").alias("node")).distinct(), "node", "left_semi")
    by = _best(g.monthly(mine), ["node"], [F.desc("month")], months)
    shown = by.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("month", F.col("n").alias("reports")))).alias("activity"))
    return shown.join(g.trend(mine, now), "node").withColumnRenamed("node", "seed")


def compared(seen: DataFrame, known: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, shared, new, not_seen): techniques seen with a seed that its own entry
    lists (itself, its parent or a sibling), those that it doesn't, and how many listed
    ones were not seen. seen and known: (seed, technique)."""
    parent = lambda c: F.substring_index(c, ".", 1)
    asked = seeds.select("seed").distinct()
    a = seen.join(asked, "seed", "left_semi").select("seed", F.upper("technique").alias("t")).distinct().withColumn("p", parent(F.col("t")))
    b = known.join(asked, "seed", "left_semi").select("seed", F.upper("technique").alias("t")).distinct().withColumn("p", parent(F.col("t")))
    listed = a.join(b.select("seed", "p").distinct().withColumn("hit", F.lit(True)), ["seed", "p"], "left")
    one = listed.groupBy("seed").agg(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("t")))).alias("shared"), F.array_sort(F.collect_set(F.when(F.col("hit").isNull(), F.col("t")))).alias("new"))
    two = b.join(a.select("seed", "p").distinct(), ["seed", "p"], "left_anti").groupBy("seed").agg(F.count("*").alias("not_seen"))
    none = F.array().cast("array<string>")
    out = b.select("seed").distinct().join(one, "seed", "left").join(two, "seed", "left")
    return out.select("seed", F.coalesce("shared", none).alias("shared"), F.coalesce("new", none).alias("new"), F.coalesce("not_seen", F.lit(0)).alias("not_seen"))


def entity_context(e: DataFrame, nodes: DataFrame, seeds: DataFrame, facts: DataFrame, pairs: DataFrame, now: str, per_type: int = 8) -> DataFrame:
    """One row a seed: node type, links by type, related, similar, activity, trend, and
    corroboration (edges stated in a sentence, edges of one report, all edges)."""
    known = seeds.select("seed").distinct().join(nodes.select(F.col("node").alias("seed"), "type"), "seed")
    ends = g.both_ways(e).join(known.select(F.col("seed").alias("node")), "node", "left_semi")
    basis = ends.groupBy(F.col("node").alias("seed")).agg(F.count_if(F.col("stated") > 0).alias("stated_links"), F.count_if(F.col("weight") == 1).alias("single_links"), F.count("*").alias("all_links"))
    by_type = links(e, nodes, known, per_type).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("type", "total", "items"))).alias("links"))
    near = related(e, nodes, known).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "peer", "score", "via"))).alias("related"))
    like = similar(pairs, known).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "shared", "score"))).alias("similar"))
    return reduce(lambda a, b: a.join(b, "seed", "left"), [by_type, near, like, activity(facts, known, now), basis], known)
