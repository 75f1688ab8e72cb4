"""Choices, excerpts, plans and audits by small cases; their queries have SQL."""

import pytest
from pyspark.sql import functions as F

from siftwork.operators import audit as au
from siftwork.operators import listing as ls
from siftwork.operators import prioritise as pr


def test_type_names():
    assert ls.doc_types(" Emulation_Plan ") == ["ADVERSARY_EMULATION_PLAN"] and ls.doc_types("threat report") == ["THREAT_REPORT"]
    assert ls.doc_types("kev entry") == ["KEV_ENTRY"] and ls.doc_types("other") == ["OTHER"] and ls.doc_types("nonsense") == []


def test_choice(spark):
    rows = [(1, ["En"], "2024-01-05", 0.5, True), (2, [], "2024-01-05", 0.5, True), (3, None, "2024-01-05", 0.5, True), (4, ["en"], None, 0.5, True), (5, ["en"], "2024-02-05", 0.5, True), (6, ["de", "EN"], "2024-01-31", 0.1, True), (7, ["en"], "2024-01-01", None, None)]
    df = spark.createDataFrame(rows, "i int, f array<string>, day string, q double, flag boolean")
    ids = lambda c: [r.i for r in df.where(ls.chosen(c, {"f": F.col("f")}, F.col("day"), F.col("q"), {"flag": F.col("flag")})).orderBy("i").collect()]
    assert ids(ls.Choice()) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(ls.Choice({"f": ["EN"]})) == [1, 4, 5, 6, 7]
    assert ids(ls.Choice({"f": ["en"]}, "2024-01-01", "2024-01-31")) == [1, 6, 7]
    assert ids(ls.Choice(least_quality=0.2)) == [1, 2, 3, 4, 5] and ids(ls.Choice(flags=["flag"])) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("text,wanted,want", [(None, ["x"], ""), ("short  text", ["none"], "short text"), ("a " * 300 + "beacon cve-2024-1234 end " + "b " * 300, ["beacon", "cve-2024-1234"], None)])
def test_excerpts(spark, text, wanted, want):
    got = spark.createDataFrame([(text,)], "t string").select(ls.excerpt_around(F.col("t"), wanted, 60).alias("e")).first().e
    if want is not None:
        assert got == want
    else:
        assert got.startswith("…") and got.endswith("…") and "cve-2024-1234" in got and len(got) <= 62 and "  " not in got


def test_unified(spark):
    s = "id string, score double, kind string"
    a, b, c = (spark.createDataFrame(r, s) for r in ([("r", 2.0, "report"), ("x", 1.0, "report")], [("x", 3.0, "group")], [("x", 9.0, "cve"), ("CVE-1", 1.0, "cve"), ("CVE-1", 0.5, "cve")]))
    assert sorted(tuple(r) for r in ls.unified(a, b, c).collect()) == [("CVE-1", 1.0, "cve"), ("r", 2.0, "report"), ("x", 3.0, "group")]


def test_plan_keeps_a_leader_of_each_tactic(spark):
    rows = [(f"T{i}", "early" if i < 8 else "late", round(0.9 - i / 20, 2), 0) for i in range(10)]
    ranked = spark.createDataFrame(rows, "id string, tactic string, score double, prevalence int")
    tactics = spark.createDataFrame([("late", 2), ("early", 1)], "tactic string, place int")
    got = {r.id: r.step for r in pr.selected(ranked, tactics, 3).collect()}
    assert {k: v for k, v in got.items() if v} == {"T0": 1, "T1": 2, "T8": 3} and len(got) == 10
    assert all(r.step for r in pr.selected(ranked, tactics, 12).collect())


def test_scores(spark):
    tech = spark.createDataFrame([("A", "x", ["Windows", "Linux"], True, False, True, 2, 4, 0.5), ("B", "x", ["macOS"], False, False, False, 0, 0, 0.0), ("C", "x", None, None, None, None, None, None, None)], "id string, tactic string, platforms array<string>, attributed boolean, chosen boolean, planned boolean, options int, prevalence int, share double")
    seen = spark.createDataFrame([("A", 1, "observed", 0.9, "2024-01-01"), ("A", 2, "mapped", 1.0, "2022-01-01")], "id string, report int, label string, confidence double, day string")
    got = {r.id: r for r in pr.scored(tech, seen, "2024-03-01", ["windows"]).collect()}
    assert set(got) == {"A"} and got["A"].fit == ["Windows"] and got["A"].reports == 2
    assert got["A"].score == round(0.25 * 0.5 + 0.1 + 0.15 * 0.9 + 0.2 + 0.05 + 0.1 + 0.1 * 0.8 + 0.05 * 0.5, 2)
    assert {r.id: r.score for r in pr.scored(tech, seen, "2024-03-01").collect()}["C"] == 0.05


def test_audit_and_its_undoing(spark):
    rows = [(1, "http://a.example/", 900, 0.9, 5, "acquired"), (2, "http://a.example/tag/x", 900, 0.9, 5, "acquired"), (3, "http://a.example/p/long-one", 100, 0.2, 0, "acquired"), (4, "http://a.example/p/other", 900, 0.9, 3, "acquired"), (5, "http://a.example/p/gone", 10, 0.0, 0, "rejected"), (6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, url string, words int, score double, iocs int, status string")
    n = {k: F.coalesce("iocs", F.lit(0)) if k == "iocs" else F.lit(0) for k in au.SIGNALS}
    audit = au.audited(df, "id", au.rules(F.coalesce("words", F.lit(0)), F.coalesce("score", F.lit(0.0)), F.coalesce("url", F.lit("http://x/p")), F.lit(""), n), {"indicators": F.col("iocs") > 0})
    got = {r.id: (r.action, r.bucket) for r in audit.collect()}
    assert got[1] == ("PRUNE", "Homepage / Root Index") and got[2][1] == "Aggregator / Index Path" and got[3][1].startswith("Stub") and got[4] == ("KEEP", "Retained")
    assert sum(r["rows"] for r in au.totals(audit).collect()) == len(rows)
    steps = au.plan(df, audit, "id")
    assert {r.id for r in steps.collect()} == {1, 2, 3, 6}
    after = au.applied(df, steps, "id")
    assert {r.id for r in after.where("status = 'rejected'").collect()} == {1, 2, 3, 5, 6}
    assert sorted(map(tuple, au.applied(after, steps, "id", undo=True).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
