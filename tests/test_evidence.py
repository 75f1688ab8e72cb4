"""Headings, context, labels and targeting: cases, and a sequential version of each fold."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.functions.batches import pieces
from siftwork.operators import evidence as ev
from siftwork.operators import extract as ex

PROSE = "The group moved from the edge appliance to the file servers and stayed there for several weeks in all."


def python_pattern(p):
    return re.compile(p.replace(r"\x{a0}", "\xa0").replace(r"\x{feff}", "﻿").replace(r"\p{L}", r"[^\W\d_]"), re.ASCII)


def found(p, s):
    return bool(python_pattern(p).search(s))


def plain_sections(text):
    """(start, heading) line by line."""
    lines = [(m.start(), m[0]) for m in re.finditer(r"[^\n\r]+", text)]
    out = []
    for i, (start, raw) in enumerate(lines):
        t = raw.strip()
        if not t:
            continue
        at = start + len(raw) - len(raw.lstrip())
        m = re.match(r"#{1,6}\s+(.+?)\s*#*$", t)
        if m:
            out.append((at, m[1]))
            continue
        words = t.split()
        if not 3 <= len(t) <= 90 or not re.match("[A-Z]", t) or len(words) > 10 or re.search(r"[.,;:!?]$|[=|{}<>$\\]|//|\.\s|^\w+ \d{1,2}, \d{4}$", t) or found(ev.NOT_HEADING, t):
            continue
        large = [w for w in words if w.lower() not in ev.SMALL_WORDS]
        ok = bool(large) and sum(bool(re.match("[A-Z0-9(\"'“]", w)) for w in large) / len(large) >= 0.6
        if not ok and len(words) <= 6:
            for _, n in lines[i + 1 : i + 4]:
                n = n.strip()
                if n and n not in "•·▪●◦‣":
                    ok = len(n) >= 80 and bool(re.search("[.!?:]$", n))
                    break
        if ok:
            out.append((at, t))
    return out


def plain_labels(text):
    """(sentence, section, is_rule) one after the other."""
    parts, parent = [], None
    for at, h in plain_sections(text):
        if found(ev.DEFENSIVE_HEADING, h):
            parent, context = h, h
        elif parent and not found(ev.NARRATIVE_HEADING, h):
            context = f"{parent} › {h}"
        else:
            parent, context = None, h
        parts.append((at, context))
    out, rule = [], False
    for s in ex.sentences(text):
        section = [c for at, c in parts if at <= s["start"]][-1:] or [None]
        t, gap = s["sentence"], s["before"]
        prose = re.search(r"[a-z]{2,}\s+[a-z]{2,}\s+[a-z]{2,}", t) and re.search(r"[.!?][\"'”’)]?$", t) and not re.search("[{}=|$]", t)
        near = gap is not None and gap.strip() == "" and gap.count("\n") <= 2
        rule = any(found(p, t) for p in ev.RULE_SYNTAX) or bool(rule and near and not prose)
        out.append((t, section[0], rule))
    return out


def test_sentences():
    text = "One ran tools, e.g. on Dr. Smith's host. Then two!  (Three) came.\n1) Item one • Item two\n- dash item.\r\n..\nT1059 | PowerShell"
    got = ex.sentences(text)
    assert [s["sentence"] for s in got] == ["One ran tools, e.g. on Dr. Smith's host.", "Then two!", "(Three) came.", "Item one", "Item two", "dash item.", "T1059 | PowerShell"]
    assert all(text[s["start"] : s["end"]] == s["sentence"] for s in got)
    assert [s["before"] for s in got][:3] == [None, " ", "  "] and ex.sentences(None) == []


def test_headings(spark):
    text = f"Life of the Threat\n{PROSE}\n## Mitigations ##\n• Block tools\nDeny local logon\n\nMixed case heading here\n  \n{PROSE}\nFigure 3 Flow of Data\nMarch 3, 2024\nKey = Value\nEnds with a Stop.\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = ev.headings(ev.text_lines(df)).orderBy("start").collect()
    assert [(r.doc_id, r.heading) for r in rows] == [(1, "Life of the Threat"), (1, "Mitigations"), (1, "Mixed case heading here")]
    assert [text[r.start :].startswith(("Life", "##", "Mixed")) for r in rows] == [True] * 3
    assert [(r.start, r.heading) for r in rows] == plain_sections(text)


CASES = [
    ("Organizations can use MFA to reduce the risk.", None, "defensive"),
    ("Customers in all regions must rotate keys.", None, "defensive"),
    ("Microsoft Defender for Endpoint detects this loader.", None, "defensive"),
    ("DeviceProcessEvents where x", None, "defensive"),
    ("T1021.001 Remote Desktop | not observed in this case", None, "negated"),
    ("T1021.001 Remote Desktop | used to reach hosts that were not confirmed", None, "observed"),
    ("The intruders couldn't find a way, and no evidence exists.", None, "negated"),
    ("Turning on tamper protection stops intruders.", None, "defensive"),
    ("The attackers disabled the antivirus of the host.", None, "observed"),
    ("Use of the tool was noted twice.", None, "observed"),
    ("Evading Detection keeps on", "Evading Detection", "observed"),
    ("The loader was placed on disk.", "Hardening › Identity", "defensive"),
    ("They stayed undetected.", None, "observed"),
    ("In May the campaign ended.", None, "observed"),
]


def test_labels(spark):
    df = spark.createDataFrame(CASES, "s string, h string, want string")
    got = df.select("s", "want", ev.sentence_label(F.col("s"), F.col("h")).alias("label")).collect()
    assert [(r.s, r.label) for r in got] == [(r.s, r.want) for r in got]


def test_mitigations_need_a_defensive_part_or_an_address(spark):
    rows = [
        ("Use rundll32 to execute the payload from disk", None, False),
        ("Use application control to stop such payloads", "Mitigations", True),
        ("Organizations should use application control.", None, True),
        ("In this post we share what organizations should do.", None, False),
        ("Defenders must do the following:", "Mitigations", False),
        ("Too short", "Mitigations", False),
    ]
    df = spark.createDataFrame(rows, "s string, h string, want boolean")
    got = df.select("s", "want", ev.is_mitigation(F.col("s"), F.lit("defensive"), F.col("h")).alias("m")).collect()
    assert [(r.s, r.m) for r in got] == [(r.s, r.want) for r in got]


def test_context_is_passed_on(spark):
    text = f"Technical Analysis\nThe loader was placed on disk.\nHardening Recommendations\nLock the hosts.\nIdentity\nRotate all keys of hosts.\nLateral Movement\n{PROSE}\nIdentity\nKeys were taken."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.sentence: (r.section, r.label) for r in ev.label_sentences(df).collect()}
    assert got["Rotate all keys of hosts."] == ("Hardening Recommendations › Identity", "defensive")
    assert got[PROSE] == ("Lateral Movement", "observed")
    assert got["Keys were taken."] == ("Identity", "observed")


def test_rule_blocks(spark):
    text = "The rule is below.\nrule Some_Loader {\n  strings:\n    $a = \"wssoft\"\n  and more of it\n\n\n\nafter a gap of lines\ntitle: other\nThis is prose that ends the block.\nplain"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.sentence, r.is_rule) for r in ev.label_sentences(df).orderBy("n").collect()]
    assert [s for s, rule in got if rule] == ["rule Some_Loader {", "strings:", '$a = "wssoft"', "and more of it", "title: other"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_sequential_version(spark, seed):
    rng = random.Random(seed)
    lines = ["Background", "Mitigations", "## Detection Queries", "Identity", "Initial Access", "Sentence case line", PROSE, "rule R {", "  $x = '1'", "condition: any", "more text of it", "", " ", "•", "The actor ran tools. Then it left.", "Hunting for It", "Defense Evasion", "T1059 | PowerShell"]
    rows = [(i, rng.choice(["\n", "\r\n", "\n\n"]).join(rng.choices(lines, k=rng.randint(0, 40)))) for i in range(60)]
    got = {}
    for r in ev.label_sentences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append((r.sentence, r.section, r.is_rule))
    for i, text in rows:
        assert got.get(i, []) == plain_labels(text)


def test_targeting(spark):
    said = [
        (1, 0, "Hospitals in the United States were hit.", "observed"),
        (1, 1, "Victims in the United  States lost data.", "observed"),
        (1, 2, "The United States may be next.", "hypothetical"),
        (1, 3, "A China-based group, operating from Iran, attacked Iranian banks.", "observed"),
        (2, 0, "Windows hosts are vulnerable.", "observed"),
        (2, 1, "Windows is an operating system.", "reference"),
        (2, 2, "They want espionage.", "observed"),
        (3, 0, "Statesmen of the United Nations spoke", "observed"),
    ]
    labelled = spark.createDataFrame(said, "doc_id long, n int, sentence string, label string")
    names = spark.createDataFrame([("geography", "United States"), ("geography", "China"), ("geography", "Iran"), ("platform", "Windows"), ("objective", "Espionage"), ("sector", "Hospitals")], "kind string, name string")
    got = sorted(tuple(r) for r in ev.targeting(labelled, names).collect())
    assert got == [
        (1, "geography", "United States", "compromised", 0.76, 3),
        (1, "sector", "Hospitals", "mentioned", 0.3, 1),
        (2, "objective", "Espionage", "targeted", 0.7, 1),
        (2, "platform", "Windows", "at_risk", 0.5, 1),
    ]
    assert ev.targeting(labelled, names.limit(0)).collect() == []


def test_targeting_by_blocks_of_names_and_with_a_null_key(spark, monkeypatch):
    monkeypatch.setattr(ev, "NAMES", 2)
    said = [(None, 0, "Alpha and beta gamma. " * 50, "observed"), (None, 1, "Beta  gamma were hit", "observed"), (7, 0, "delta, epsilon; beta", "observed")]
    labelled = spark.createDataFrame(said, "doc_id long, n int, sentence string, label string")
    names = spark.createDataFrame([("x", n) for n in ("alpha", "beta gamma", "delta", "epsilon", "zeta")], "kind string, name string")
    out = ev.targeting(labelled, names)
    assert sorted((str(r.doc_id), r.name, r.mentions) for r in out.collect()) == [("7", "delta", 1), ("7", "epsilon", 1), ("None", "alpha", 1), ("None", "beta gamma", 2)]
    shuffled = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert shuffled and not any("hashpartitioning(run#" in x for x in shuffled)  # sentences are not shuffled by their runs


def test_looks_before_patterns_change_no_label(spark, monkeypatch):
    """Sentences of pieces, whole matches and other words: as told by every pattern on every sentence."""
    rng = random.Random(4)
    whole = "no evidence|did not|couldn’t find|cannot confirm|was not seen|has not been observed|is a sub-technique|adversaries may|if an attacker|for instance|can be abused|can  use|it is important to|is recommended|Microsoft Defender for Endpoint detects|APT 29 group also ran|Volt Typhoon uses|we have found|defense evasion|evade the detection|avoids detection|T1059.001 Shell | no evidence|level: high|title =|$a = \"x\"|x|contains|has_any|SecurityEvent|DeviceFileEvents|alert tcp|rule x {|MITRE ATT&CK defines|used by attackers|abused by adversaries".split("|")
    pieces = [x for xs in ev.NEEDS.values() for x in xs] + whole * 3 + "the a threat actor operators have could was been to of on İ ſ x_ T105 user-must".split() * 4
    said = [None, ""] + [rng.choice(["", " ", "- "]) + "".join(rng.choice([x, x, x.upper(), x.title()]) + rng.choice([" ", " ", " ", "-", ". ", ""]) for x in rng.choices(pieces, k=rng.choice([1, 2, 4]))) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, rng.choice([None, None, None, "Mitigations", "Overview"])) for i, s in enumerate(said)], "i int, s string, h string").cache()
    label = lambda: [tuple(r) for r in df.select("i", "s", ev.sentence_label(F.col("s"), F.col("h")), ev.is_rule(F.col("s"))).orderBy("i").collect()]
    plain = "The loader was placed on the first of these hosts by them."
    told = [*ev.RULE_SYNTAX, ev.MAPPING_ROW, *ev.NEGATION, *ev.REFERENCE, *ev.CONDITIONAL, *ev.ADVICE_START, *ev.ADDRESSED, ev.DEFENSIVE_WORDS, ev.MODAL]
    assert not df.select(ev.hinted(F.lit(plain), told, F.lower(F.lit(plain)))).first()[0]
    got = label()
    monkeypatch.setattr(ev, "NEEDS", {})
    assert got == label()


def test_sentences_come_piece_by_piece(spark, monkeypatch):
    """A row a sentence under a key of any type, with pieces of a few bytes as with one of all."""
    rows = [((i, "k"), t) for i, t in enumerate([None, "", "One ran. Then two!\n- three", "Über é ran. So é did. " * 30, " \n", "x" * 50])]
    df = spark.createDataFrame(rows, "k struct<a: long, b: string>, text string").coalesce(1)
    want = [(k, n, s["start"], s["end"], s["sentence"], s["before"]) for k, t in rows for n, s in enumerate(ex.sentences(t))]
    got = lambda: [(tuple(r[0]), *r[1:]) for r in ex.split_sentences(df, "k").orderBy("k.a", "n").collect()]
    assert got() == want
    monkeypatch.setattr(ex, "pieces", lambda col: pieces(col, 20))
    assert got() == want
    texts = pa.array([t for _, t in rows])
    cut = list(pieces(texts, 20))
    assert [a for a, _ in cut] + [len(rows)] == [0] + [b for _, b in cut] and all(b == a + 1 or sum(len((t or "").encode()) for _, t in rows[a:b]) <= 20 for a, b in cut)


def test_sentences_bring_their_code_along(spark, monkeypatch):
    """Workers need not have the package installed."""
    sent = []
    monkeypatch.setattr(ex, "ship", sent.append, raising=False)
    df = spark.createDataFrame([(1, "One. Two.")], "k long, text string")
    assert ex.split_sentences(df, "k").count() == 2 and len(sent) == 1
