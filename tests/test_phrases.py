"""Phrases against plain searches, and the rules by which a phrase names a technique."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import phrases as ph

TECHNIQUES = [
    ("T1003", "OS Credential Dumping"),
    ("T1003.001", "OS Credential Dumping: LSASS Memory"),
    ("T1003.003", "OS Credential Dumping: NTDS"),
    ("T1566", "Phishing"),
    ("T1566.001", "Phishing: Spearphishing Attachment"),
    ("T1598", "Phishing for Information"),
    ("T1550.002", "Use Alternate Authentication Material: Pass the Hash"),
    ("T1021.001", "Remote Services: Remote Desktop Protocol"),
    ("T1021.002", "Remote Services: SMB/Windows Admin Shares"),
    ("T1053.003", "Scheduled Task/Job: Cron"),
    ("T1072", "Software"),
]
SYNONYMS = [("rdp", "T1021.001"), ("kerberoast", "T1558.003"), ("Pass-the-hash attack", "T1550.002")]


@pytest.fixture
def dims(spark):
    return spark.createDataFrame(TECHNIQUES, "id string, name string"), spark.createDataFrame(SYNONYMS, "phrase string, id string")


def test_names_shorthand_and_cover(spark, dims):
    want = {
        "RDP": {("T1021.001", "synonym")},
        "kerberoast": set(),
        "pass the hash": {("T1550.002", "name")},
        "Pass the Hash attack": {("T1550.002", "synonym")},
        "phishing": {("T1566", "name")},
        "LSASS dumping": {("T1003.001", "token-cover")},
        "dumped credentials": {("T1003", "token-cover")},
        "remote service": {("T1021.001", "token-cover")},
        "the windows shares": {("T1021.002", "token-cover")},
        "software": set(),
        "cron": set(),
        "nothing here": set(),
        "": set(),
        "spearphishing attachments": {("T1566.001", "token-cover")},
    }
    got = {k: set() for k in want}
    for r in ph.match_phrases(spark.createDataFrame([(k,) for k in want], "phrase string"), *dims).collect():
        got[r.phrase].add((r.id, r.via))
    assert got == want
    assert {r.via for r in ph.match_phrases(spark.createDataFrame([(k,) for k in want], "phrase string"), *dims, cover=False).collect()} == {"synonym", "name"}


def test_related_and_tactics(spark, dims):
    ids = spark.createDataFrame([("t1003",), ("T1021.002",), ("T1566.001",)], "id string")
    assert {tuple(r) for r in ph.related(ids, dims[0]).collect()} == {("T1003", "T1003.001"), ("T1003", "T1003.003"), ("T1566.001", "T1566")}
    asked = spark.createDataFrame([("lateral movement",), ("Lateral",), ("c2",), ("none",)], "phrase string")
    got = {r.phrase: r.tactic for r in ph.match_tactics(asked, ["Lateral Movement", "Command and Control"]).collect()}
    assert got == {"lateral movement": "Lateral Movement", "Lateral": "Lateral Movement", "c2": "Command and Control"}


def test_a_querys_words(spark, dims):
    found, left = ph.resolve_words(spark, "apt29 lsass dumping via rdp and pass the hash".split(), *dims)
    assert found == [("lsass dumping via", "T1003.001", "token-cover"), ("rdp", "T1021.001", "synonym"), ("and pass the hash", "T1550.002", "token-cover")] and left == ["apt29"]
    assert ph.resolve_words(spark, [], *dims) == ([], [])


def test_texts_against_plain_search(spark):
    rng = random.Random(3)
    words = ["pass", "the", "hash", "a.b", "it's", "é", "x-y", "x"]
    texts = [(i, rng.choice(["  ", " ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, "")]
    dictionary = [("Pass the", "A"), ("the", "B"), ("the the", "C"), ("hash pass the", "D"), ("the", "E"), ("x y", "F"), ("a.b it’s", "G"), ("", "H")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    said = spark.createDataFrame(dictionary, "phrase string, id string")
    norm = lambda s: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789.'" else " " for c in (s or "").lower().replace("’", "'")).split())
    want = set()
    for i, t in texts:
        ws = norm(t).split()
        for p, k in dictionary:
            p = norm(p).split()
            at = [j for j in range(len(ws) - len(p) + 1) if ws[j : j + len(p)] == p] if p else []
            if at:
                want.add((i, k, " ".join(p), len(at), at[0]))
    for most in (1000, 2):  # the automaton, then the join
        got = ph.find(docs, said, most=most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ph.find(docs, said.limit(0)).collect() == [] and ph.find(docs.limit(0), said).collect() == []
