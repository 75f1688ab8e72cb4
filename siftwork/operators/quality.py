"""Rule-based quality, gate and type decisions as Column cascades."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions.text import let

# Terms that speak for a threat report, and what a text's evidence adds to its score.
SIGNAL_WORDS = (
    "ransomware", "credential", "lateral movement", "persistence", "command and control", "exfiltration", "initial access", "privilege escalation", "defense evasion", "att&ck",
    "mitre", "powershell", "mimikatz", "ntds.dit", "rdp", "cobalt strike", "c2", "ioc", "ttp",
)
BASE = 0.22
LENGTH_STEPS = [(2500, 0.28), (1200, 0.2), (500, 0.1)]
SHORT_WITH_ARTIFACT, SHORT = 0.16, -0.12
TERM_STEPS = [(8, 0.28), (4, 0.18), (2, 0.08), (0, -0.1)]
EVIDENCE = {
    "command": (r"(?i)(?:powershell|cmd|wmic|schtasks|vssadmin|rundll32|certutil|reg|psexec|whoami|nltest|net\s+user|mimikatz|rubeus)\b[^\r\n]{5,100}", 0.22),
    "registry": (r"(?i)\b(?:HKLM|HKCU)\\[a-zA-Z0-9_\\]{4,80}\b", 0.12),
    "event": (r"(?i)\b(?:Event\s*ID\s*(?:4688|4624|7045|1102)|Sysmon\s*(?:1|3|10))\b", 0.12),
    "cve": (r"(?i)CVE-\d{4}-\d+", 0.1),
    "stages": (r"(?i)\bstage\s*[123]|infection chain|attack chain|kill chain|lateral movement.*exfil", 0.18),
    "technique": (r"\bT1\d{3}\b|(?i:att&ck)", 0.12),
    "emerging": (r"(?i)\b(?:byovd|direct syscalls|unhooking|amsi bypass|aadrefreshtoken|lotc)\b", 0.16),
}
#: Lower-case pieces of which a text has at least one wherever its evidence is found (beside what `_found` says of commands).
PIECES = {
    "registry": ("hklm", "hkcu"), "event": ("event", "sysmon"), "cve": ("cve-",), "stages": ("stage", "chain", "lateral movement"), "technique": ("t1", "att&ck"),
    "emerging": ("byovd", "direct syscalls", "unhooking", "amsi bypass", "aadrefreshtoken", "lotc"),
}
COMMANDS = ("powershell", "cmd", "wmic", "schtasks", "vssadmin", "rundll32", "certutil", "psexec", "whoami", "nltest", "mimikatz", "rubeus")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _found(kind: str, text: Column, low: Column) -> Column:
    """Whether the evidence is in text; its pattern is tried only where low, lower-case
    and with all of text in it, has a piece that it can't do without."""
    if kind == "command":
        may = _any(low.contains(w) for w in COMMANDS) | (low.contains("net") & low.contains("user")) | (low.contains("reg") & text.rlike(r"(?i)reg\b"))
    else:
        may = _any(low.contains(w) for w in PIECES[kind])
    return may & text.rlike(EVIDENCE[kind][0])


def _stepped(n: Column, steps: list[tuple[int, float]], below: Column | float = 0.0) -> Column:
    """What the first step reached adds."""
    out = below if isinstance(below, Column) else F.lit(below)
    for least, add in reversed(steps):
        out = F.when(n >= least, add).otherwise(out)
    return out


def quality_score(text: Column, title: Column) -> Column:
    """The score of `assessed`."""
    return assessed(text, title)["score"]


def assessed(text: Column, title: Column) -> Column:
    """struct of word_count and score. The score is 0..1, two decimals: a base, what length and vocabulary add, and a fold over the
    table of evidence. A title counts where it names stages, techniques or what is new."""
    body = F.concat_ws("\n", title, text)

    def facts(low: Column) -> Column:
        seen = {k: _found(k, body if k in ("stages", "emerging") else text, low) for k in EVIDENCE}
        seen["technique"] = low.contains("att&ck") | seen["technique"]
        terms = sum((low.contains(w).cast("int") for w in SIGNAL_WORDS), F.lit(0))
        return F.struct(word_count(text).alias("words"), terms.alias("terms"), *[c.alias(k) for k, c in seen.items()])

    def points(x: Column) -> Column:
        artifact = x["command"] | x["registry"] | x["cve"]
        total = F.lit(BASE) + _stepped(x["words"], LENGTH_STEPS, F.when(artifact, SHORT_WITH_ARTIFACT).otherwise(SHORT)) + _stepped(x["terms"], TERM_STEPS)
        for kind, (_, add) in EVIDENCE.items():
            total = total + F.when(x[kind], add).otherwise(0.0)
        score = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 100, 6) + 0.5) / 100
        return F.struct(x["words"].alias("word_count"), score.alias("score"))

    # Facts are looked for once: points ask for them up to three times, and for lower case some fifty times.
    return let(let(F.lower(body), facts), points)


def library_gate(keep: Column, structured: Column, techniques: Column, indicators: Column, commands: Column, quality: Column, words: Column, page_type: Column, content: Column, topic: Column, low_value: Column) -> Column:
    """Reason for leaving a report out, or null: page type, content, topic, stub, low
    value; the first that holds. Hard evidence, or quality where there is no
    text, overrides the page type; keep and structured rows pass always."""
    hard = (techniques >= 1) | (indicators >= 2) | (commands >= 2) | ((words == 0) & (quality >= 0.7))
    return (
        F.when(keep | structured, None)
        .when(page_type & ~hard, "page_type")
        .when(content & ~hard, "content")
        .when(topic & ~hard, "off_topic")
        .when(words.between(1, 119) & (indicators == 0), "stub")
        .when(low_value & ~hard, "low_value")
    )


def type_votes(signals: DataFrame, key: str, least: float = 2.4, share: float = 0.35, most: int = 4) -> DataFrame:
    """(key, type, score, reason) from (key, type, weight, reason): summed scores that
    reach both bounds, most types at most, strongest reason each."""
    sums = signals.groupBy(key, "type").agg(F.sum("weight").alias("score"), F.max_by("reason", F.struct("weight", "reason")).alias("reason"))
    w = W.partitionBy(key)
    bound = F.greatest(F.lit(least), share * F.max("score").over(w))
    r = F.row_number().over(w.orderBy(F.desc("score"), "type"))
    return sums.withColumn("_b", bound).withColumn("_r", r).where((F.col("score") >= F.col("_b")) & (F.col("_r") <= most)).drop("_b", "_r")


def provenance(doc_types: Column, syndicated: Column, official: Column, analysed: Column, quality: Column) -> Column:
    """Confidence class, its weight and tier, and the confidence they give; fixed weights."""
    cls = F.when(official, "official").when(F.array_contains(doc_types, "STRUCTURED"), "structured").when(analysed, "primary").when(syndicated, "syndicated").otherwise("secondary")
    weight = F.when(cls == "official", 1.0).when(cls.isin("structured", "primary"), 0.9).when(cls == "secondary", 0.75).otherwise(0.6)
    tier = F.when(cls == "official", 1).when(cls.isin("structured", "primary"), 2).when(cls == "secondary", 3).otherwise(4)
    q = F.when(quality > 1, quality / 100).otherwise(quality)
    return F.struct(cls.alias("class"), tier.alias("tier"), F.round(weight * F.coalesce(q, F.lit(0.5)), 3).alias("confidence"))


def severity(ransomware: Column, listed: Column, impact: Column, observed: Column, confidence: Column, age_days: Column, behaviours: Column) -> Column:
    """critical, high, medium or low, by the first rule that holds."""
    return (
        F.when(ransomware | (impact & (age_days <= 90) & (confidence >= 0.85)), "critical")
        .when(listed | impact | ((observed >= 5) & (age_days <= 180)), "high")
        .when(behaviours > 0, "medium")
        .otherwise("low")
    )


def review_action(verdict: Column, protected: Column, confidence: Column, hidden_by: Column, may_hide: Column, evidence: Column) -> Column:
    """What a review changes: unchanged, keep, flag, hide or restore."""
    return (
        F.when(hidden_by.isin("rules", "analyst"), "unchanged")
        .when((hidden_by == "ai") & evidence, "restore")
        .when(verdict == "useful", "keep")
        .when(verdict == "unsure", "flag")
        .when(protected | (confidence < 0.85) | ~may_hide, "flag")
        .otherwise("hide")
    )


def evaluation(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """Precision and recall of a decision."""
    tp, fp, fn = F.count_if(predicted & truth), F.count_if(predicted & ~truth), F.count_if(~predicted & truth)
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
