"""Entity context of many seeds, and analyses held against their texts."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import context as cx
from siftwork.operators import extract as ex
from siftwork.operators import grounding as gd

EDGES = "source string, target string, predicate string, confidence double, weight long, stated long, last_seen string"


def graph(spark, seed):
    rng = random.Random(seed)
    kinds = {f"n{i}": rng.choice(["actor", "technique", "malware", "indicator"]) for i in range(18)}
    edges = {}
    for _ in range(60):
        a, b = rng.sample(sorted(kinds), 2)
        edges[a, b, rng.choice("xy")] = (round(rng.random(), 2), rng.randint(1, 5), rng.randint(0, 1))
    rows = [(a, b, p, *v, "2024-01-01") for (a, b, p), v in edges.items()]
    return kinds, rows, spark.createDataFrame(rows, EDGES), spark.createDataFrame(list(kinds.items()), "node string, type string")


def plain_related(kinds, rows, seed, first_hops, most):
    import math

    power = lambda r: math.log2(1 + r[4]) * (0.4 + r[3]) * (1.5 if r[5] else 1)
    adj = {}
    for r in rows:
        adj.setdefault(r[0], []).append((r[1], power(r), r[2]))
        adj.setdefault(r[1], []).append((r[0], power(r), r[2]))
    direct = {p for p, *_ in adj.get(seed, [])}
    score = {}
    for mid, s1, _ in sorted(adj.get(seed, []), key=lambda x: (-x[1], x[0], x[2]))[:first_hops]:
        if kinds[mid] == "indicator":
            continue
        for far, s2, _ in adj[mid]:
            if far == seed or far in direct or kinds[far] == "indicator" or kinds[far] == kinds[seed] == "technique":
                continue
            via = score.setdefault(far, {})
            via[mid] = via.get(mid, 0) + s1 * s2 / math.log2(2 + len(adj[mid]))
    total = {f: sum(v.values()) for f, v in score.items()}
    top = max(total.values(), default=1)
    order = sorted(total, key=lambda f: (-round(total[f], 9), f))[:most]
    return [(f, math.floor(round(total[f] / top * 100, 6) + 0.5) / 100, sorted(score[f], key=lambda m: (-round(score[f][m], 9), m))[:3]) for f in order]


@pytest.mark.parametrize("seed", [1, 2])
def test_related_against_a_walk(spark, seed):
    kinds, rows, e, nodes = graph(spark, seed)
    seeds = spark.createDataFrame([(n,) for n in kinds] + [("nobody",)], "seed string")
    got = {}
    for r in cx.related(e, nodes, seeds, first_hops=4, most=5).orderBy("seed", "rank").collect():
        got.setdefault(r.seed, []).append((r.peer, r.score, r.via))
    assert got == {n: want for n in kinds if (want := plain_related(kinds, rows, n, 4, 5))}


def test_context_in_one_row_a_seed(spark):
    kinds, rows, e, nodes = graph(spark, 3)
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n2",), ("nobody",)], "seed string")
    facts = spark.createDataFrame([("n1", 1, "2024-01-01"), ("n1", 2, "2023-06-01"), ("n3", 1, "2024-01-01")], "node string, report long, seen string").withColumn("seen", F.to_date("seen"))
    pairs = e.select(F.col("source").alias("node"), F.col("target").alias("feature")).union(e.select("target", "source"))
    got = {r.seed: r for r in cx.entity_context(e, nodes, seeds, facts, pairs, "2024-01-20").collect()}
    assert set(got) == {"n1", "n2"} and got["n1"].trend == "steady" and [a.month for a in got["n1"].activity] == ["2023-06", "2024-01"] and got["n2"].trend is None
    mine = [r for r in rows if "n1" in r[:2]]
    assert (got["n1"].all_links, got["n1"].stated_links, got["n1"].single_links) == (len(mine), sum(r[5] for r in mine), sum(r[4] == 1 for r in mine))
    assert sum(x.total for x in got["n1"].links) == len(mine) and all(len(x["items"]) <= 8 for x in got["n1"].links)


def test_known_against_seen(spark):
    seen = spark.createDataFrame([("g", "T1003.001"), ("g", "t1566"), ("g", "T1059"), ("x", "T1")], "seed string, technique string")
    known = spark.createDataFrame([("g", "T1003"), ("g", "T1059.001"), ("g", "T1021"), ("h", "T1")], "seed string, technique string")
    got = {r.seed: (r.shared, r.new, r.not_seen) for r in cx.compared(seen, known, spark.createDataFrame([("g",), ("h",), ("x",)], "seed string")).collect()}
    assert got == {"g": (["T1003.001", "T1059"], ["T1566"], 1), "h": ([], [], 1)}


TEXT = "Intro.  The **actor** used\u00a0hxxps://bad[.]example(dot)com — “fast”, then\nleft.  It ran `rundll32` twice; nobody in the whole team saw CVE-2024-1234 there."


@pytest.mark.parametrize(
    "quote,found",
    [
        ('"The actor used https://bad.example.com"', "The **actor** used\u00a0hxxps://bad[.]example(dot)com"),
        ('bad.example.com - "fast", then left', 'bad[.]example(dot)com — “fast”, then\nleft'),
        ("too short", None),
        ("It ran rundll32 three times in all", None),
        ("Other words came first; nobody in the whole team saw CVE-2024-1234 there", "nobody in the whole team saw CVE-2024-1234 there"),
        ("used https://bad[.]example[.]com", "used\u00a0hxxps://bad[.]example(dot)com"),
    ],
)
def test_quotes_are_placed_in_the_original(quote, found):
    hit = gd.place(*gd.normalised(TEXT), quote)
    assert (hit is None) == (found is None)
    if found:
        assert TEXT[hit[1] : hit[2]] == found


def test_grounding_tables(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 0, "the actor USED https"), (1, 1, "never said at all"), (2, 0, "the actor used https"), (3, 0, "the actor used https")], "doc_id long, n long, quote string")
    assert [(r.doc_id, r.n, TEXT[r.start : r.end]) for r in gd.ground_quotes(texts, quotes).collect()] == [(1, 0, "The **actor** used\u00a0hxxps")]
    s = texts.select("doc_id", gd.ground_summary(F.lit("It used CVE-2024-1234. It hit 1.2.3.4 too! Nothing more. T1059 was used."), F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert tuple(s[0].s) == ("It used CVE-2024-1234. Nothing more.", 2) and tuple(s[1].s) == ("Nothing more.", 3)
    values = spark.createDataFrame([(1, "Bad.Example.com"), (1, "other.example.com"), (1, "x"), (2, "bad")], "doc_id long, value string")
    assert [r.value for r in gd.ground_values(values, texts).collect()] == ["Bad.Example.com"]
    flat = texts.where("doc_id = 1").select(gd.flat_text(F.col("text"))).first()[0]
    assert flat == gd.normalised(TEXT)[0]


def test_article_prose(spark):
    text = "[Home](/) | [News](/n)\nFirst *line*\n first LINE \n1) [A](b) - [C](d(e))\nSee [this](u) now\nfirst *LINE*\n\n- [x](y) abcd\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "[a](b)")], "doc_id long, text string")
    got = {r.doc_id: r.prose for r in ex.article_prose(df).collect()}
    assert got == {1: "First *line*\nfirst LINE\nSee this now\n- x abcd", 2: "", 3: ""}
