"""Search documents of reports and cards, and what queries mean in them."""

import pytest
from pyspark.sql import functions as F

from siftwork.operators import search as sr
from siftwork.operators import searchdocs as sd

TECHNIQUES = [("T1003", "OS Credential Dumping", ["Credential Access"], ["Windows"], ["Process"]), ("T1003.001", "OS Credential Dumping: LSASS Memory", ["Credential Access"], [], []), ("T1566", "Phishing", ["Initial Access"], None, None)]
CARDS = [
    ("group", "G1", "Scattered Fox", "A group. " + "It moves on. " * 60, ["Octo Fox", "UNC1"]),
    ("group", "G2", "Bear", "A bear.", None),
    ("software", "S1", "Loader", "It loads.", ["ldr-x"]),
    ("campaign", "C1", "Long Night", "Used CVE-2024-1111 and cve-2024-1111.", []),
]
LINKS = [("G1", "S1"), ("C1", "G1"), ("G1", "T1566"), ("G1", "T1003.001"), ("S1", "T1003")]
REPORTS = [
    (1, "Octo Fox returns", "octo fox and OCTO FOX used LDR-X; the Bear slept, a bear too. T1003.001 and t1566, T9999. CVE-2024-2222 " + "x " * 400, "2024-02-01", 80.0, "Pub"),
    (2, "", None, None, 0.5, ""),
    (3, "Bearing", "Bear-like and Bear_1, but no more.", None, None, None),
]
STATED = [(1, "group", "UNC1"), (1, "group", "unc1"), (1, "group", "Nobody"), (1, "software", "none identified"), (1, "technique", "t1566: Phishing"), (1, "tactic", "Impact"), (1, "cve", "cve-2024-3333"), (1, "cve", "CVE-1"), (2, "record", "G2")]


@pytest.fixture
def t(spark):
    cards = spark.createDataFrame(CARDS, "kind string, id string, name string, description string, aliases array<string>")
    names = cards.select("kind", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return {
        "cards": cards,
        "aliases": names,
        "links": spark.createDataFrame(LINKS, "id string, other string"),
        "techniques": spark.createDataFrame(TECHNIQUES, "id string, name string, tactics array<string>, platforms array<string>, components array<string>"),
        "reports": spark.createDataFrame(REPORTS, "id long, title string, text string, published_at string, quality double, publisher string"),
        "stated": spark.createDataFrame(STATED, "report long, kind string, value string"),
    }


def reports(t):
    return sd.report_docs(t["reports"], t["stated"], t["cards"], t["aliases"], t["techniques"])


def test_reports(t):
    got = {r.id: r for r in reports(t).collect()}
    assert set(got) == {"1", "2", "3"} and list(got["1"].asDict()) == sd.COLUMNS
    one = got["1"]
    assert [tuple(e) for e in one.entities] == [("group", "G1", "Scattered Fox", "Octo Fox", 4, "mention"), ("group", "G2", "Bear", "Bear", 1, "mention"), ("software", "S1", "Loader", "ldr-x", 1, "mention")]
    assert (one.techniques, one.tactics, one.cves) == (["T1003.001", "T1566"], ["Credential Access", "Impact", "Initial Access"], ["CVE-2024-2222", "CVE-2024-3333"])
    assert one.actor_names == ["Scattered Fox", "Bear", "Nobody"] and one.quality == 0.8 and len(one.summary) == 599 and str(one.published_at) == "2024-02-01"
    two = got["2"]
    assert [tuple(e) for e in two.entities] == [("group", "G2", "Bear", "Bear", 10, "mention")] and (two.title, two.body, two.quality, two.cves) == ("Untitled report", "", 0.5, [])
    assert got["3"].entities == [] and got["3"].publisher == ""


def test_cards_have_the_same_schema(t):
    docs = sd.knowledge_docs(t["cards"], t["links"], t["techniques"])
    assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in reports(t).schema]
    got = {r.id: r for r in docs.collect()}
    assert set(got) == {"G1", "G2", "S1", "C1", "T1003", "T1003.001", "T1566"}
    g = got["G1"]
    assert [(e.kind, e.id, e.rel, e["count"]) for e in g.entities] == [("group", "G1", "self", 10), ("campaign", "C1", "uses", 0), ("software", "S1", "uses", 0)]
    assert (g.techniques, g.tactics, g.aliases) == (["T1003.001", "T1566"], ["Credential Access", "Initial Access"], ["Scattered Fox", "Octo Fox", "UNC1", "G1"])
    assert g.summary.endswith("on.…") and len(g.summary) <= 421 and g.doc_types == ["MITRE_GROUP"]
    assert got["C1"].cves == ["CVE-2024-1111"] and got["S1"].entities[1].id == "G1"
    assert got["T1003"].body == "T1003 OS Credential Dumping. Tactics: Credential Access. Platforms: Windows. Data components: Process." and got["T1003"].summary == "Credential Access — Windows"
    assert got["T1003.001"].aliases == ["T1003.001", "LSASS Memory"] and got["T1003.001"].url.endswith("/T1003/001/") and got["T1566"].body == "T1566 Phishing. Tactics: Initial Access."


def test_what_a_query_means(spark, t):
    none = spark.createDataFrame([("lsass", "T1003.001")], "phrase string, id string")
    m = sd.meaning(spark, "octo fox lsass CVE-2024-2222, lateral movement with T1566 bears recon".split(), t["aliases"], t["techniques"], none, ["Lateral Movement", "Reconnaissance"])
    assert (m.entities, m.techniques, m.tactics, m.cves, m.words) == ([("group", "G1")], ["T1566", "T1003.001"], ["Lateral Movement"], ["CVE-2024-2222"], ["with", "bears", "recon"])
    docs = reports(t).unionByName(sd.knowledge_docs(t["cards"], t["links"], t["techniques"]))
    got = {r.id: (round(r.boost, 3), sorted(p.part for p in r.parts)) for r in sd.meant_boosts(docs, m).collect()}
    # Four mentions and the title; both techniques; the identifier.
    assert got["1"] == (round(4 * (1 + min(1, 2.321928 / 3)) + 1 + 3 + 3 + 5, 3), ["CVE-2024-2222", "T1003.001", "T1566", "group G1"])
    assert got["G1"] == (8.0 + 0.6 + 0.6, ["T1003.001", "T1566", "group G1"]) and got["S1"] == (0.8 + 0.3, ["T1003.001", "group G1"]) and got["T1566"][0] == 8.0 and got["T1003"] == (2.0, ["T1003.001"]) and got["3"] == (0.0, [])
    assert sd.meant_boosts(docs, sd.Meaning()).where("boost <> 0").count() == 0


@pytest.mark.parametrize(
    "raw,want",
    [
        ('actor:"Octo Fox"', {"1", "G1", "C1", "S1"}),
        ("actor:unc1 -malware:ldr-x", {"C1"}),
        ("actor:slept", {"1"}),
        ("technique:T1003", {"1", "G1", "S1", "T1003", "T1003.001"}),
        ("technique:T1003.001", {"1", "G1", "S1", "T1003", "T1003.001"}),
        ("technique:phishing", {"1", "G1", "T1566"}),
        ("tactic:initial-access type:report", {"1"}),
        ("cve:2024-2222", {"1"}),
        ("type:group", {"G1", "G2"}),
        ("-type:group -type:technique -type:report", {"2", "3", "S1", "C1"}),
        ("tier:1 type:software,mitre-campaign", {"S1"}),
        ("publisher:attack has:iocs", set()),
        ("since:2024-01 until:2024 -type:group", {"1", "S1", "C1", "T1003", "T1003.001", "T1566"}),
        ('"the bear slept"', {"1"}),
        ("type:report -octo", set()),
    ],
)
def test_filters(spark, t, raw, want):
    none = spark.createDataFrame([], "phrase string, id string")
    q = sr.interpret(raw)
    docs = reports(t).withColumn("doc_types", F.when(F.col("id") == "1", F.array(F.lit("THREAT_REPORT"))).otherwise(F.col("doc_types"))).unionByName(sd.knowledge_docs(t["cards"], t["links"], t["techniques"]))
    keep, warnings = sd.hard_filter(q, t["aliases"], t["techniques"], none, ["Initial Access"])
    assert {r.id for r in docs.where(keep).select("id").collect()} == want
    assert bool(warnings) == ("mitre-campaign" in raw)
