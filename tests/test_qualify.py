"""Evidence, noise and the decision with its reasons."""

from pyspark.sql import functions as F

from siftwork.operators import qualify as q

LONG = "the team wrote many plain words about nothing in particular today " * 40
ROWS = [
    (1, "Report", "We saw powershell -enc AAAA run.\ncmd.exe /c whoami\nreg add HKLM\\Software\\Run here\nschtasks /create x\nEvent ID 4688. CVE-2024-1234, T1059 and 10.1.2.3. threat actor, payload, beacon, loader. attack chain"),
    (2, "Short", "only a few words here"),
    (3, "Sales", "Request a demo and start your free trial. " + LONG),
    (4, "Paper", "Request a demo and start your free trial at IEEE. " + LONG),
    (5, "Plain", LONG + " ransomware payload and beacon of a threat actor"),
    (6, "", None),
    (7, "Driver", LONG + " byovd; lsass. T1003.001"),
    (8, "Short but real", "CVE-2024-9999 is exploited."),
]


def found(spark, **more):
    df = spark.createDataFrame(ROWS, "doc_id long, title string, text string")
    return {r.doc_id: r for r in q.qualify(df, **more).collect()}


def test_evidence(spark):
    one = found(spark)[1].evidence
    assert one.commands == ["powershell -enc AAAA run.", "cmd.exe /c whoami", "reg add HKLM\\Software\\Run here", "schtasks /create x"]
    assert one.registry == ["HKLM\\Software\\Run"] and one.events == ["Event ID 4688"] and one.paths == [] and one.cve and one.technique and one.indicator


def test_decisions(spark):
    got = found(spark)
    flat = lambda r: (r.qualified.permissive, r.qualified.balanced, r.qualified.strict)
    assert flat(got[1]) == (True, True, True) and got[1].classification == "ADVERSARY_EMULATION" and got[1].simulation == 1.0
    assert got[1].reasons[0].startswith("Adversary emulation") and "Dense execution commands (4 found)" in got[1].reasons and "Specific telemetry event IDs (Event ID 4688)" in got[1].reasons and "High adversary emulation replay value (100%)" in got[1].reasons
    assert got[1].score == 1.0
    assert flat(got[2]) == (False,) * 3 and "too short" in got[2].rejection and got[2].score == 0.15 and got[2].kind == "VULNERABILITY_ADVISORY"
    assert "Commercial" in got[3].rejection and got[3].noise == 2
    assert "Lacks actionable" in got[4].rejection
    assert got[5].classification == "THREAT_ACTOR_REPORT" and flat(got[5]) == (True, True, False) and got[5].rejection is None
    assert "too short" in got[6].rejection
    assert got[7].emerging == "BYOVD Driver Weaponization" and "Detected novel/emerging procedure: BYOVD Driver Weaponization" in got[7].reasons and got[7].simulation == 0.4
    assert flat(got[8]) == (True, True, False) and got[8].classification == "VULNERABILITY_REPORT"


def test_earlier_checks_and_settings(spark):
    got = found(spark, url_reason=F.when(F.col("doc_id") == 1, "Paginated listing page"), depth_reason=F.when(F.col("doc_id") == 5, "no depth"), min_words=3)
    assert got[1].rejection == "REJECTED: Paginated listing page" and got[1].score == 0.1 and got[5].rejection == "REJECTED: no depth"
    assert "Lacks actionable" in got[2].rejection
    assert found(spark, from_feed=True)[5].score == round(found(spark)[5].score + 0.05, 2)


def test_terms_are_whole_words(spark):
    df = spark.createDataFrame([("adapts beacons",), ("apt, (beacon) cve-2024-1",), ("ntdsxdit ntds.dit",), ("",)], "t string")
    assert [r[0] for r in df.select(q.term_count(F.col("t"))).collect()] == [0, 3, 1, 0]


def test_terms_are_looked_for_plainly_first(spark):
    """A regular expression is run only where a text has the term's letters; whole words count as before."""
    df = spark.createDataFrame([("an apt, cve-1 and mitre att&ck.",), ("adapt xcve-1 ntdsxdit",), ("ntds.dit",), ("",)], "low string")
    counted = df.select(q.term_count(F.col("low")).alias("n"))
    assert [r.n for r in counted.collect()] == [3, 0, 1, 0]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Contains(low") >= len(q.TERMS)
