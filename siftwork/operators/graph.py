"""Entity graphs as two tables: mentions (report, node, confidence) and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.session import pieces

#: Members of a list that stands for as many rows in a shuffle.
BLOCK = 1024


def noisy_or(confidence: Column, cap: float = 0.95, most: float = 0.99) -> Column:
    """Aggregate: 1 - product of (1 - c), every c cut at cap, the whole at most, two decimals."""
    left = F.exp(F.sum(F.log1p(-F.least(confidence, F.lit(cap)))))
    return F.floor(F.round(F.least(F.lit(most), 1 - left) * 100, 6) + 0.5) / 100


def edges(facts: DataFrame) -> DataFrame:
    """facts (source, predicate, target, report, confidence, stated, seen) to one
    edge per (source, predicate, target): the best confidence of each report,
    joined by noisy-or; weight is the number of reports."""
    keys = ["source", "predicate", "target"]
    per_report = facts.groupBy(*keys, "report").agg(F.max("confidence").alias("c"), F.max(F.col("stated").cast("int")).alias("stated"), F.max("seen").alias("seen"))
    return per_report.groupBy(*keys).agg(
        noisy_or(F.col("c")).alias("confidence"), F.count("*").alias("weight"), F.sum("stated").alias("stated"), F.max("seen").alias("last_seen")
    )


def mentions(evidence: DataFrame, listed: DataFrame, key: str = "report", most: int = 150) -> DataFrame:
    """(report, node, kind, confidence): what a report's evidence names, or its older
    list where it has no evidence; the best confidence of each, and of indicators the
    most certain (a shown list). Both: (report, node, kind, confidence)."""
    # One shuffle by report: what a report's list is worth is decided where its evidence is.
    both = evidence.withColumn("_old", F.lit(False)).unionByName(listed.withColumn("_old", F.lit(True))).repartition(pieces(evidence), key)
    one = both.groupBy(key, "node", "kind", "_old").agg(F.max("confidence").alias("confidence"))
    one = one.withColumn("_seen", F.min("_old").over(W.partitionBy(key))).where((F.col("_old") == F.col("_seen")) | F.col(key).isNull()).drop("_old", "_seen")
    r = F.row_number().over(W.partitionBy(key, "kind").orderBy(F.desc("confidence"), "node"))
    return one.withColumn("_r", r).where((F.col("kind") != "indicator") | (F.col("_r") <= most)).drop("_r")


def co_reported(named: DataFrame, stated: DataFrame, pairs: dict[tuple[str, str], tuple[str, float]], key: str = "report") -> DataFrame:
    """Facts (source, predicate, target, report, confidence, stated): what reports state,
    at least .5 sure, and what they name together: of two kinds that go together the
    smaller confidence times the pair's weight. pairs: (kind, kind) to (predicate, weight).
    A report names a bounded number of nodes, and only pairs of fitting kinds are made."""
    # A report's names and statements meet in its row, so that its facts need no shuffle of their own before its best ones are found.
    # Both are dealt by report in the same way, so that Spark keeps them there (an outer join would not).
    n = pieces(named)
    names = named.repartition(n, key).select(key, F.struct("kind", "node", "confidence").alias("x"), F.lit(None).alias("y"))
    said = stated.repartition(n, key).select(key, F.lit(None).alias("x"), F.struct("source", "predicate", "target", F.greatest("confidence", F.lit(0.5)).cast("double").alias("c")).alias("y"))
    rows = names.union(said).groupBy(key).agg(F.collect_list("x").alias("named"), F.collect_list("y").alias("said"))
    text = lambda v: F.lit(v).cast("string")

    def begun(kind: str, other: str, predicate: str, share: float) -> Column:
        of = lambda x: F.struct(x["node"].alias("source"), text(predicate).alias("predicate"), F.lit(None).cast(stated.schema["target"].dataType).alias("target"), (x["confidence"] * share).cast("double").alias("c"), text(other).alias("other"), F.lit(float(share)).alias("share"))
        return F.transform(F.filter("named", lambda x: x["kind"] == kind), of)

    starts = [begun(a, b, p, w) for (a, b), (p, w) in pairs.items()]
    told = F.transform("said", lambda x: F.struct(x["source"].alias("source"), x["predicate"].alias("predicate"), x["target"].alias("target"), x["c"].alias("c"), text(None).alias("other"), F.lit(None).cast("double").alias("share")))
    starts = F.flatten(F.array_compact(F.array(*starts, told)))
    rows = rows.select(key, "named", F.explode(starts).alias("s"))
    other = F.filter("named", lambda x: x["kind"] == F.col("s.other"))
    ends = F.when(F.col("s.other").isNull(), F.array(F.struct(F.col("s.target").alias("target"), F.col("s.c").alias("c"))))
    ends = ends.otherwise(F.transform(other, lambda x: F.struct(x["node"].alias("target"), F.least(F.col("s.c"), x["confidence"] * F.col("s.share")).cast("double").alias("c"))))
    rows = rows.select(key, "s.source", "s.predicate", F.col("s.other").isNull().alias("stated"), F.explode(ends).alias("t"))
    return rows.where(F.col("stated") | (F.col("source") != F.col("t.target"))).select("source", "predicate", F.col("t.target").alias("target"), key, F.col("t.c").alias("confidence"), "stated")


def focus(e: DataFrame, node: object, ring: int = 40) -> DataFrame:
    """Edges of a node's view: its strongest ring of neighbours, and the edges among these and it."""
    s = e.withColumn("s", strength(F.col("weight"), F.col("confidence"), F.col("stated")))
    near = both_ways(s).where(F.col("node") == node).groupBy("peer").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "peer").limit(ring)
    seen = near.select(F.col("peer").alias("n")).union(e.sparkSession.createDataFrame([(node,)], near.select("peer").schema).select(F.col("peer").alias("n")))
    kept = e.join(F.broadcast(seen.withColumnRenamed("n", "source")), "source", "left_semi")  # ring + 1 rows
    return kept.join(F.broadcast(seen.withColumnRenamed("n", "target")), "target", "left_semi")


def nodes(facts: DataFrame) -> DataFrame:
    """(node, reports, first_seen, last_seen) over facts (node, report, seen)."""
    one = facts.groupBy("node", "report").agg(F.min("seen").alias("a"), F.max("seen").alias("b"))
    return one.groupBy("node").agg(F.count("*").alias("reports"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))


def both_ways(e: DataFrame) -> DataFrame:
    """Adjacency: each edge from either end, as (node, peer, ...)."""
    rest = [c for c in e.columns if c not in ("source", "target")]
    return e.select(F.col("source").alias("node"), F.col("target").alias("peer"), *rest).union(e.select(F.col("target").alias("node"), F.col("source").alias("peer"), *rest))


def strength(weight: Column, confidence: Column, stated: Column) -> Column:
    return F.log2(1 + weight) * (0.4 + confidence) * F.when(stated > 0, 1.5).otherwise(1.0)


def importance(reports: Column, degree: Column, last_seen: Column, now: str) -> Column:
    age = F.coalesce(F.datediff(F.lit(now).cast("date"), last_seen.cast("date")), F.lit(3650))
    return 2 * F.log2(1 + reports) + F.log2(1 + degree) + 1 / (1 + F.greatest(age, F.lit(0)) / 180)


def top_edges(e: DataFrame, per_node: int = 24) -> DataFrame:
    """Edges among the strongest per_node of either end, and all stated ones."""
    s = e.withColumn("s", strength(F.col("weight"), F.col("confidence"), F.col("stated")))
    ends = both_ways(s.withColumn("key", F.struct("source", "predicate", "target")))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("s"), "key"))
    kept = ends.withColumn("r", rank).where((F.col("r") <= per_node) | (F.col("stated") > 0))
    return kept.select("key.source", "key.predicate", "key.target", "confidence", "weight", "stated", "last_seen").distinct()


def similar(links: DataFrame, least_shared: int = 2, least_score: float = 0.08, hub: int | None = None) -> DataFrame:
    """(a, b, shared, score), a < b: weighted Jaccard of the features that two
    nodes are linked to, a feature's weight being ln(1 + N / df).

    links: (node, feature). A feature of n nodes makes n * n / 2 pairs; with
    hub, features of more nodes than that still count in what a node has in
    all, but pair no nodes. similar_to() asks for one node and needs no hub.
    """
    out = alike(links, None, least_shared, least_score, hub)
    return out.select("a", "b", "shared", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"))


def alike(links: DataFrame, seeds: DataFrame | None, least_shared: int, least_score: float, hub: int | None = None) -> DataFrame:
    """(a, b, shared, score, both): each pair of similar nodes once, its score not rounded.
    seeds: (node), distinct; pairs without a seed are not looked at, a is one, and both
    says whether b is one too. Without seeds every node is one, and a < b.

    A feature's nodes go to each of them as lists of those behind it, BLOCK at most,
    not as a row a pair: sums are made where the lists arrive."""
    n = links.select("node").distinct().agg(F.count("node").alias("n_nodes"))
    one = links.select("node", "feature").where("feature IS NOT NULL").distinct()  # said here, so that both ways below share a shuffle
    asked = F.lit(True)
    if seeds is not None:
        one = one.join(seeds.select("node", F.lit(True).alias("asked")), "node", "left")
        asked = F.coalesce("asked", F.lit(False))
    # Seeds first: a pair is met in the list of its first node.
    r = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("asked"), "node"))
    placed = one.select("node", "feature", asked.alias("asked")).withColumn("block", F.floor((r - 1) / BLOCK))
    lists = placed.groupBy("feature", "block", "asked").agg(F.collect_list("node").alias("nodes"), F.count("*").alias("k"))
    whole = W.partitionBy("feature")
    lists = lists.withColumn("df", F.sum("k").over(whole)).withColumn("last", F.max("block").over(whole)).crossJoin(F.broadcast(n))  # one row
    lists = lists.select("feature", "block", "last", "asked", F.array_sort("nodes").alias("nodes"), "df", F.log(1 + F.col("n_nodes") / F.col("df")).alias("w"))
    all_w = lists.select(F.explode("nodes").alias("node"), "w").groupBy("node").agg(F.sum("w").alias("all_w"))
    side = lists if hub is None else lists.where(F.col("df") <= hub)
    # Blocks of a feature meet by pairs of blocks, so that a frequent feature is many keys.
    first = side.where("asked").select("feature", F.col("nodes").alias("mine"), "w", F.col("block").alias("own"), F.explode(F.sequence("block", "last")).alias("block"))
    met = first.join(side.select("feature", "block", "nodes", F.col("asked").alias("both")), ["feature", "block"])
    met = met.select("w", "nodes", "both", (F.col("own") == F.col("block")).alias("same"), F.posexplode("mine").alias("at", "a"))
    behind = F.when(F.col("same") & F.col("both"), F.slice("nodes", F.col("at") + 2, F.greatest(F.size("nodes"), F.lit(1)))).otherwise(F.col("nodes"))
    met = met.select("a", "w", "both", behind.alias("bs")).where(F.size("bs") > 0).repartition(pieces(links), "a")
    pairs = met.select("a", "w", "both", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("w").alias("w"), F.first("both").alias("both")).where(F.col("shared") >= least_shared)
    # A node has at least what it shares, so the first bound loses no pair.
    pairs = pairs.join(all_w.select(F.col("node").alias("a"), F.col("all_w").alias("wa")), "a").where(F.col("w") >= least_score * F.col("wa") * (1 - 1e-9))
    score = F.col("w") / (F.col("wa") + F.col("wb") - F.col("w"))
    out = pairs.join(all_w.select(F.col("node").alias("b"), F.col("all_w").alias("wb")), "b").withColumn("score", score)
    return out.where(F.col("score") >= least_score).select("a", "b", "shared", "score", "both")


def similar_to(links: DataFrame, node: object, limit: int = 6, least_shared: int = 2, least_score: float = 0.08) -> DataFrame:
    """The nodes most similar to one node: (node, shared, score); joins from the one side only."""
    one = links.select("node", "feature").distinct()
    n = one.agg(F.countDistinct("node").alias("n_nodes"))
    df = one.groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    w = one.join(df.withColumn("w", F.log(1 + F.col("n_nodes") / F.col("df"))), "feature")
    mine = w.where(F.col("node") == node).select("feature", F.col("w").alias("mine"))
    total = mine.agg(F.sum("mine").alias("wa"))
    all_w = w.join(mine, "feature", "left").where(F.col("node") != node).groupBy("node").agg(F.count("mine").alias("shared"), F.sum("mine").alias("common"), F.sum("w").alias("wb"))
    score = F.col("common") / (F.col("wa") + F.col("wb") - F.col("common"))
    out = all_w.where(F.col("shared") >= least_shared).crossJoin(F.broadcast(total)).where(score >= least_score)
    return out.select("node", "shared", (F.floor(score * 100 + 0.5) / 100).alias("score")).orderBy(F.desc("score"), F.desc("shared"), "node").limit(limit)


def related_through(e: DataFrame, node: object, first_hops: int = 60, limit: int = 10) -> DataFrame:
    """Nodes two steps away and not one: (peer, score, through). Each path adds
    the product of its strengths over log2(2 + the middle's degree); scores are
    relative to the best one."""
    ends = both_ways(e.withColumn("s", strength(F.col("weight"), F.col("confidence"), F.col("stated")))).select("node", "peer", "s")
    near = ends.where(F.col("node") == node).groupBy(F.col("peer").alias("mid")).agg(F.max("s").alias("s1"))
    first = near.orderBy(F.desc("s1"), "mid").limit(first_hops)
    # Only the middles' edges are looked at further: first_hops rows to join them by.
    of_mid = ends.withColumnRenamed("node", "mid").join(F.broadcast(first), "mid").groupBy("mid", "s1", "peer").agg(F.max("s").alias("s"))
    degree = of_mid.groupBy("mid").agg(F.count("*").alias("deg"))
    far = of_mid.join(F.broadcast(degree), "mid").where(F.col("peer") != node)  # a row a middle
    far = far.join(near.select(F.col("mid").alias("peer")), "peer", "left_anti")
    sums = far.groupBy("peer").agg(F.sum(F.col("s1") * F.col("s") / F.log2(2 + F.col("deg"))).alias("x"), F.count("*").alias("through"))
    top = sums.agg(F.max("x").alias("top"))
    score = F.floor(F.col("x") / F.col("top") * 1000 + 0.5) / 1000
    return sums.crossJoin(F.broadcast(top)).select("peer", score.alias("score"), "through").orderBy(F.desc("score"), "peer").limit(limit)


def paths(e: DataFrame, start: object, goal: object, depth: int = 4, per_node: int = 60, limit: int = 5) -> DataFrame:
    """Shortest connections: (hops, path, strength), strongest first, those equal to
    six digits in the order of their paths as written with >; at each step only a node's per_node strongest edges are followed, and the search
    ends at the first length that connects. One join a step, depth at most."""
    adj = both_ways(e.withColumn("s", strength(F.col("weight"), F.col("confidence"), F.col("stated")))).groupBy("node", "peer").agg(F.max("s").alias("s"))
    top = adj.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("s"), "peer"))).where(F.col("r") <= per_node).drop("r")
    front = top.where(F.col("node") == start).select(F.array("node", "peer").alias("path"), F.col("peer").alias("at"), F.col("s").alias("strength"))
    for hops in range(1, depth + 1):
        found = front.where(F.col("at") == goal)
        if hops == depth or not found.isEmpty():
            return found.select(F.lit(hops).alias("hops"), "path", "strength").orderBy(F.desc(F.round("strength", 6)), F.array_join("path", ">")).limit(limit)
        step = top.select(F.col("node").alias("at"), "peer", "s")
        front = front.join(step, "at").where(~F.array_contains("path", F.col("peer"))).select(F.concat("path", F.array("peer")).alias("path"), F.col("peer").alias("at"), F.least("strength", "s").alias("strength"))
    raise AssertionError


def overview(n: DataFrame, quota: int = 60, least: int = 3) -> DataFrame:
    """Quotas per node type: each type's share of quota (least at least) by score,
    and what is left over to the best of the rest. n: (node, type, score)."""
    total = n.agg(F.count("*").alias("all_nodes"))
    share = n.groupBy("type").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total))
    share = share.select("type", F.greatest(F.lit(least), F.floor(quota * F.col("k") / F.col("all_nodes"))).alias("q"))
    r = F.row_number().over(W.partitionBy("type").orderBy(F.desc("score"), "node"))
    ranked = n.withColumn("r", r).join(F.broadcast(share), "type")  # a row a type
    first = ranked.where(F.col("r") <= F.col("q")).select("node", "type", "score", F.lit(0).alias("pass"))
    rest = ranked.where(F.col("r") > F.col("q")).select("node", "type", "score", F.lit(1).alias("pass")).orderBy(F.desc("score"), "node").limit(quota)
    return first.union(rest).orderBy("pass", F.desc("score"), "node").limit(quota)


def prevalence(links: DataFrame) -> DataFrame:
    """(feature, users, share): nodes that use a feature, and that over the most used one's."""
    n = links.groupBy("feature").agg(F.countDistinct("node").alias("users"))
    most = n.agg(F.max("users").alias("most"))
    return n.crossJoin(F.broadcast(most)).select("feature", "users", (F.col("users") / F.col("most")).alias("share"))


def monthly(facts: DataFrame) -> DataFrame:
    """(node, month, n): reports a month over (node, report, seen)."""
    return facts.groupBy("node", F.date_format(F.date_trunc("month", "seen"), "yyyy-MM").alias("month")).agg(F.countDistinct("report").alias("n"))


def trend(facts: DataFrame, now: str) -> DataFrame:
    """(node, last90, prior90, trend) from (node, report, seen): new, rising, dormant, falling or steady."""
    one = facts.groupBy("node", "report").agg(F.max("seen").cast("date").alias("d"))
    age = F.datediff(F.lit(now).cast("date"), F.col("d"))
    sums = one.groupBy("node").agg(
        F.count_if((age >= 0) & (age <= 90)).alias("last90"), F.count_if((age > 90) & (age <= 180)).alias("prior90"), F.max(age).alias("oldest"), F.min(age).alias("newest")
    )
    word = (
        F.when(F.col("oldest") <= 60, "new")
        .when((F.col("last90") > F.col("prior90")) & (F.col("last90") >= 2), "rising")
        .when(F.col("newest") > 365, "dormant")
        .when(F.col("last90") < F.col("prior90"), "falling")
        .otherwise("steady")
    )
    return sums.select("node", "last90", "prior90", word.alias("trend"))


def decayed_activity(facts: DataFrame, now: str, half_life: float = 180.0) -> DataFrame:
    """(node, score): 10 for each report, halved every half_life days; undated ones count as 365 days old."""
    age = F.coalesce(F.greatest(F.datediff(F.lit(now).cast("date"), F.col("seen").cast("date")), F.lit(0)), F.lit(365))
    return facts.groupBy("node").agg((F.floor(F.sum(10 * F.pow(F.lit(0.5), age / half_life)) * 100 + 0.5) / 100).alias("score"))
