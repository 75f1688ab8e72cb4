import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm.mixing import document_mix, mix, raked, sampled, scale_for, topic, words


def make(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "en", "fr", None])
        rows.append((i, rng.choice(["w " * rng.randrange(1, 200), "A | b | c", "HI!! " * 5, "a#$ %^ 12 &* " * 9]), lang, "hot" if i % 3 else f"s{i % 7}"))
    rows += [(1000, None, "en", "hot"), (1001, "", None, None), (1001, "", None, None), (None, "x y", "de", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def raked_plainly(cells, goals, rounds=300):
    """cells: {(values): tokens}; goals: per margin {value: share}."""
    w, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    for _ in range(rounds):
        for m, goal in enumerate(goals):
            for v in {c[m] for c in cells}:
                now = sum(cells[c] * w[c] for c in cells if c[m] == v)
                for c in cells:
                    if c[m] == v:
                        w[c] *= goal.get(v, 0) * total / now if now else 0
    return w


def test_against_plain_raking(spark):
    df = make(spark)
    got = document_mix(df.selectExpr("*", "'clash' as weight", "1 as tokens", "'x' as topic"), budget=0.4).collect()
    assert len(got) == 904
    cells = {}
    for r in got:
        c = (r.source, r.lang, r.topic)
        cells[c] = cells.get(c, 0) + r.tokens
    goals = []
    for m in range(3):
        t = {}
        for c, n in cells.items():
            t[c[m]] = t.get(c[m], 0) + n
        z = sum(n**0.5 for n in t.values())
        goals.append({v: n**0.5 / z for v, n in t.items() if n})
    w, total = raked_plainly(cells, goals), sum(cells.values())
    for r in got:
        assert abs(r.weight - w[r.source, r.lang, r.topic]) < 0.01 * max(1, r.weight)
        assert r.margin_error <= 1e-4
    for m, name in enumerate(("source", "lang", "topic")):
        for v, share in goals[m].items():
            assert abs(sum(r.tokens * r.weight for r in got if r[name] == v) / total - share) < 2e-4
    assert abs(sum(r.tokens * r.probability for r in got) - 0.4 * total) < 1e-6 * total
    assert abs(sum(r.tokens for r in got if r.sampled) / total - 0.4) < 0.06
    kept = [r.doc_id for r in sampled(df, 0.4).collect()]
    assert sorted(kept, key=str) == sorted((r.doc_id for r in got if r.sampled), key=str)
    assert document_mix(df.limit(0)).count() == 0 and sampled(df.limit(0)).columns == df.columns


def test_rows_that_repeat_long_texts_and_rows_without_an_id(spark):
    rows = [(i, "many words " * 20, "en", "a") for i in range(200)] + [(None, f"no id at all {i} " * 9, "en", "a") for i in range(200)]
    rows += [(7, "many words " * 20, "en", "a")] * 3 + [(900, "long " * 300_000, "en", "b")]
    got = document_mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), budget=0.9).collect()
    assert len(got) == len(rows) and max(r.tokens for r in got) == 300_000
    assert len({r.sampled for r in got if r.doc_id == 7}) == 1  # copies are drawn alike
    small = document_mix(spark.createDataFrame(rows[:-1], "doc_id long, text string, lang string, source string"), budget=0.5).collect()
    assert 60 < sum(r.sampled for r in small if r.doc_id is None) < 140


def test_scale_and_given_targets(spark):
    t, w = np.array([10.0, 20, 70, 5]), np.array([5.0, 1, 0.1, 0])
    cells = spark.createDataFrame(list(zip(t.tolist(), w.tolist())), "tokens double, weight double")
    s = scale_for(cells, 30)
    assert abs((t * np.minimum(1, s * w)).sum() - 30) < 1e-9
    assert scale_for(cells, 200) == np.inf
    df = make(spark)
    goal = spark.createDataFrame([("en", 0.2), ("fr", 0.8)], "value string, share double")
    got = mix(df, {"lang": F.col("lang")}, words(F.col("text")), {"lang": goal}).toPandas()
    tw = got.assign(x=got.tokens * got.weight).fillna({"lang": "?"}).groupby("lang").x.sum()
    assert abs(tw["fr"] / tw.sum() - 0.8) < 1e-9 and tw["?"] == 0
    with pytest.raises(ValueError, match="xx"):
        mix(df, {"lang": F.col("lang")}, words(F.col("text")), {"lang": spark.createDataFrame([("xx", 0.5), ("en", 0.5)], "value string, share double")})
    assert {r[0] for r in df.select(topic(F.col("text"))).distinct().collect()} >= {"empty", "table", "capitals", "symbols", "short"}


def rake(spark, cells, first, second):
    df = spark.createDataFrame([(a, b, n) for (a, b), n in cells.items()], "a string, b string, tokens long").coalesce(1)
    goal = lambda g: spark.createDataFrame(list(g.items()), "value string, share double").coalesce(1)
    return raked(df, ["a", "b"], {"a": goal(first), "b": goal(second)})


@pytest.mark.parametrize(
    "cells,first,second",
    [
        ({("x", "u"): 1, ("x", "v"): 100_000, ("y", "u"): 100_000, ("y", "v"): 1}, {"x": 0.7, "y": 0.3}, {"u": 0.7, "v": 0.3}),
        ({("wiki", "en"): 9000, ("wiki", "de"): 10, ("blog", "en"): 20, ("blog", "de"): 5000}, {"wiki": 0.5, "blog": 0.5}, {"en": 0.7, "de": 0.3}),
    ],
)
def test_nearly_separate_cells_are_raked_to_the_end(spark, cells, first, second):
    """The error stands still for rounds while small cells grow."""
    got, error = rake(spark, cells, first, second)
    assert error <= 1e-4
    plain, total = raked_plainly(cells, [first, second], 400), sum(cells.values())
    for r in got.collect():
        assert r.tokens * r.weight / total == pytest.approx(cells[r.a, r.b] * plain[r.a, r.b] / total, abs=3e-4)
    assert got.columns == ["a", "b", "tokens", "weight"]


def test_contradicting_margins_end_with_a_warning(spark):
    cells = {("x", "u"): 100, ("y", "v"): 100}
    with pytest.warns(UserWarning, match="off by"):
        _, error = rake(spark, cells, {"x": 0.7, "y": 0.3}, {"u": 0.4, "v": 0.6})
    assert error == pytest.approx(0.3, abs=1e-3)
