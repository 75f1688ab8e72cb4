"""Whether a text is worth keeping: evidence, noise, class, scores and a decision with its reasons.

All rules are rows of tables. Facts about a text are computed once; a class is
the first row that holds, scores are sums over rows, and every row that holds
leaves its reason. One pass gives the decision at all three levels of strictness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators import extract as ex

# ---- Fixed values: what counts as evidence, noise, a class or a term. ----

EVIDENCE = {
    "commands": r"(?i)(?:(?:powershell(?:\.exe)?|cmd(?:\.exe)?|wmic|schtasks|vssadmin|rundll32|certutil|bitsadmin|reg(?:\.exe)?|psexec|whoami|nltest|net\s+(?:user|group|localgroup|view|use)|procdump|mimikatz|rubeus|adfind|powerview|chisel|rclone|megasync|curl|mshta|cscript|wscript|sc(?:\.exe)?|wevtutil|nltest)\b[^\r\n]{4,140})",
    "registry": r"(?i)\b(?:HKLM|HKCU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER)\\[a-zA-Z0-9_\\]{4,100}\b",
    "paths": r"(?i)(?:[a-zA-Z]:\\(?:Windows|Users|ProgramData|AppData|Temp)\\[a-zA-Z0-9_.\\]{4,100}|\/(?:etc|tmp|dev\/shm|var\/tmp|opt)\/[a-zA-Z0-9_./]{3,100})",
    "events": r"(?i)\b(?:Event\s*ID\s*(?:4688|4624|4672|7045|1102|4720|4726|4738|8007)|Sysmon\s*(?:Event\s*)?(?:1|3|7|8|10|11|12|13|22))\b",
}
#: Items of each kind that are listed and counted.
LISTED = {"commands": 15, "registry": 10, "paths": 10, "events": 8}
FLAGS = {
    "cve": r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    "technique": r"(?i)\bT1\d{3}(?:\.\d{3})?\b",
    "indicator": r"(?i)\b(?:[a-f0-9]{32}|[a-f0-9]{64}|(?:[0-9]{1,3}\.){3}[0-9]{1,3})\b",
}
EMERGING = {
    "BYOVD Driver Weaponization": r"(?i)\b(?:bring your own vulnerable driver|byovd|gdrv\.sys|mhyprot2|procexp\.sys|vulnerable signed driver|kill edr driver)\b",
    "Direct Syscall & EDR Unhooking": r"(?i)\b(?:direct syscalls|hells gate|halos gate|unhooking|ntallocatevirtualmemory|ntwritevirtualmemory|syscall stub)\b",
    "AMSI & ETW Patching": r"(?i)\b(?:amsi bypass|amsiscanbuffer|patching etw|etweventwrite|disable amsi)\b",
    "Cloud & Entra ID Identity Theft": r"(?i)\b(?:aadrefreshtoken|primary refresh token|prt extraction|roadrecon|entra id token|device registration service)\b",
    "Living-Off-The-Cloud Execution": r"(?i)\b(?:living off the cloud|lotc|azure automation runbook|aws lambda execution|github actions runner abuse)\b",
    "Process Tampering & Early Cascade": r"(?i)\b(?:process hollowing|process doppelganging|process herpaderping|early cascade injection|mockingjay)\b",
    "Shadow Coercion & Relay": r"(?i)\b(?:petitpotam|shadowcoercion|dfscoerce|webclient relay|adcs esc\d+)\b",
}
MARKETING = [
    r"(?i)\b(?:request|schedule|book)\s+(?:a\s+)?demo\b",
    r"(?i)\b(?:start\s+your\s+)?free\s+trial\b",
    r"(?i)\bpricing\s+plans?\b",
    r"(?i)\bgartner\s+(?:magic\s+quadrant|peer\s+insights)\b",
    r"(?i)\bnamed\s+a\s+leader\s+in\b",
    r"(?i)\bour\s+platform\s+(?:protects|empowers|secures|delivers)\b",
    r"(?i)\bcontact\s+(?:sales|our\s+sales\s+team)\b",
    r"(?i)\bdownload\s+(?:our\s+)?(?:solution\s+brief|datasheet|whitepaper\s+overview)\b",
    r"(?i)\bwebinar\s+registration\b",
    r"(?i)\bannual\s+(?:revenue|growth|quarterly\s+earnings)\b",
    r"(?i)\bcyber\s+insurance\s+policy\b",
    r"(?i)\bhiring\s+(?:security\s+engineers|account\s+executives)\b",
    r"(?i)\bpress\s+release\s+distribution\b",
    r"(?i)\bannounces\s+appointment\s+of\b",
]
CONFERENCE = r"(?i)\b(?:black hat|def con|usenix|ieee|rsa conference)\b"
TERMS = (
    "initial access|lateral movement|credential access|persistence|privilege escalation|defense evasion|command and control|exfiltration|powershell|cobalt strike|mimikatz|ntds.dit|lsass|process injection|ransomware|infostealer|webshell|"
    "rootkit|c2 server|attack chain|infection chain|kill chain|execution flow|ttps|mitre att&ck|atomic red team|adversary emulation|emulation plan|sigma rule|yara rule|threat hunting|incident response|post-compromise|threat actor|apt|"
    "zero-day|remote code execution|reverse shell|beacon|payload|dropper|cve-|vulnerability|exploit|iocs|hashes|sha256"
).split("|")
#: (class, kind, pattern in the lower-case prose, fact that is enough without it, reason): the first row that holds.
CLASSES = [
    ("ADVERSARY_EMULATION", "PROCEDURE_DEEPDIVE", r"adversary emulation|emulation plan|micro-emulation|attackiq|caldera|atomic red team|procedure execution", ("commands", 3), "Adversary emulation scenario / procedure execution blueprint"),
    ("PURPLE_TEAM", "PROCEDURE_DEEPDIVE", r"purple team|attack simulation|breach and attack", None, "Purple-team simulation & emulation procedures"),
    ("ATTACK_CHAIN_REPORT", "FULL_ATTACK_CHAIN", r"attack chain|infection chain|kill chain|execution flow|stage 1|stage 2|lateral movement.*exfiltration", None, "End-to-end multi-stage intrusion attack chain"),
    ("INTRUSION_REPORT", "FULL_ATTACK_CHAIN", r"incident response|intrusion analysis|dfir|intrusion report|timeline of intrusion", None, "Chronological intrusion investigation & timeline"),
    ("MALWARE_ANALYSIS", "MALWARE_ANALYSIS", r"malware analysis|reverse engineering|payload analysis|loader|infostealer|c2 protocol|decompil|disassembly", None, "Reverse-engineering malware & tooling teardown"),
    ("DETECTION_RESEARCH", "DETECTION_GUIDANCE", r"sigma rule|yara rule|detection engineering|hunting query|kql|splunk query|mitigation guidance", ("events", 1), "Defensive detection rules & hunting engineering"),
    ("VULNERABILITY_REPORT", "VULNERABILITY_ADVISORY", r"vulnerability analysis|proof of concept|exploit analysis|zero-day advisory", ("cve", 1), "Vulnerability exploitation & advisory research"),
    ("THREAT_ACTOR_REPORT", "THREAT_ACTOR_DOSSIER", r"threat actor|apt\d+|sandworm|fin\d+|lazarus|scattered spider|volt typhoon|unc\d+|state-sponsored", None, "Targeted threat actor dossier & campaign tracking"),
]
OTHERWISE = ("THREAT_REPORT", "CAMPAIGN_INTEL")
PHASES = r"initial access.*execution.*lateral movement|attack chain|kill chain"
#: (fact, at least, points, reason). Of rows of one fact the first that holds counts. %d stands for the fact, %s for its items.
SIMULATION = [
    ("commands", 4, 0.35, "Dense execution commands (%d found)"),
    ("commands", 1, 0.20, "Actionable execution commands (%d found)"),
    ("artifacts", 1, 0.15, "System persistence / artifact paths identified"),
    ("events", 1, 0.15, "Specific telemetry event IDs (%s)"),
    ("phases", 1, 0.15, "Multi-phase sequential attack progression"),
    ("emerging", 1, 0.15, "Detected novel/emerging procedure: %s"),
]
QUALITY = [
    ("words", 1000, 0.20, None),
    ("words", 400, 0.10, None),
    ("terms", 6, 0.25, "High density of threat terms (%d)"),
    ("terms", 3, 0.14, None),
    ("terms", 1, 0.08, None),
    ("technique", 1, 0.12, "MITRE ATT&CK technique IDs detected"),
    ("cve", 1, 0.10, "CVE vulnerability references detected"),
    ("indicator", 1, 0.10, "Technical IOC artifacts (hashes/IPs) detected"),
    ("replay", 60, 0.15, "High adversary emulation replay value (%d%%)"),
    ("emerging", 1, 0.12, None),
]
BASE, BASE_FEED, BASE_SIMULATION = 0.35, 0.40, 0.25

# ---- Facts ------------------------------------------------------------------


def _round(c: Column) -> Column:
    return F.floor(F.round(c * 100, 6) + 0.5) / 100


def evidence(prose: Column) -> Column:
    """struct of the distinct commands, registry keys, paths and event ids of a text,
    in order, and of whether it names a CVE, a technique or an indicator."""
    def items(kind: str) -> Column:
        found = F.transform(F.regexp_extract_all(prose, F.lit(EVIDENCE[kind]), F.lit(0)), lambda x: F.btrim(x, F.lit(" \t\n\r")))
        if kind == "commands":
            found = F.filter(F.transform(found, lambda x: F.regexp_replace(x, "^[`'\"]+|[`'\"]+$", "")), lambda x: (F.length(x) > 8) & ~x.contains("<") & ~x.contains(">"))
        return F.slice(F.array_distinct(found), 1, LISTED[kind]).alias(kind)

    return F.struct(*[items(k) for k in EVIDENCE], *[prose.rlike(p).alias(k) for k, p in FLAGS.items()])


def emerging(text: Column) -> Column:
    """The first of the new procedures that a text shows, or null."""
    return reduce(lambda later, row: F.when(text.rlike(row[1]), row[0]).otherwise(later), reversed(list(EMERGING.items())), F.lit(None).cast("string"))


def marketing(text: Column, title: Column) -> Column:
    """struct(hits, phrases, pure): sales phrases; pure noise are two or more outside of conference papers."""
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    phrases = F.filter(F.array(*[F.trim(F.regexp_extract(both, p, 0)) for p in MARKETING]), lambda p: p != "")
    return F.struct(F.size(phrases).alias("hits"), phrases.alias("phrases"), ((F.size(phrases) >= 2) & ~both.rlike(CONFERENCE)).alias("pure"))


def term_count(low: Column) -> Column:
    """How many of the terms a lower-case text has, in whole words ("cve-" begins one)."""
    quoted = lambda t: "".join("\\" + c if c in r".*+?^${}()|[]\-&" else c for c in t)
    # Most texts lack most terms: a plain look is enough to say so.
    each = [low.contains(t) & low.rlike(rf"(?:^|[^a-z0-9]){quoted(t)}" + ("" if t.endswith("-") else r"(?:[^a-z0-9]|$)")) for t in TERMS]
    return reduce(lambda a, b: a + b, [c.cast("int") for c in each])


# ---- Decision ---------------------------------------------------------------

_RESULT = "struct<permissive:boolean,balanced:boolean,strict:boolean>"


def _sum(rows: list[tuple], facts: dict[str, Column], said: dict[str, Column]) -> tuple[Column, Column]:
    """Points and reasons of the rows that hold, one row a fact."""
    points, reasons, before = F.lit(0.0), [], {}
    for fact, least, add, reason in rows:
        holds = facts[fact] >= least
        first = holds & ~before.get(fact, F.lit(False))
        before[fact] = before.get(fact, F.lit(False)) | holds
        points += F.when(first, add).otherwise(0.0)
        if reason:
            text = F.format_string(reason.replace("%d", "%d"), facts[fact].cast("int")) if "%d" in reason else F.concat(F.lit(reason.split("%s")[0]), said[fact], F.lit(reason.split("%s")[1])) if "%s" in reason else F.lit(reason)
            reasons.append(F.when(first, text))
    return points, F.array_compact(F.array(*reasons))


def qualify(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", url_reason: Column | None = None, depth_reason: Column | None = None, from_feed: bool = False, min_score: float = 0.40, min_words: int = 200) -> DataFrame:
    """One row per row of docs (distinct keys): key, qualified (permissive, balanced,
    strict), rejection (why it is out at any level, or null), score, simulation,
    classification, kind, reasons, evidence, noise (sales phrases), emerging.

    url_reason, depth_reason: why earlier checks turn a row down, null where they
    don't. Prose is the text under its title without links and repeated lines.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(title), F.lit("")).alias("title"), (F.lit(None).cast("string") if url_reason is None else url_reason).alias("bad_url"), (F.lit(None).cast("string") if depth_reason is None else depth_reason).alias("shallow"))
    prose = ex.article_prose(rows.select(key, F.concat_ws("\n", "title", "text").alias("text")), key)
    rows = rows.join(prose, key)
    rows = rows.select("*", F.lower("prose").alias("low"), evidence(F.col("prose")).alias("evidence"), emerging(F.col("text")).alias("emerging"), marketing(F.col("text"), F.col("title")).alias("noise"))
    rows = rows.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).withColumn("terms", term_count(F.col("low")))
    e = F.col("evidence")
    size = {k: F.size(e[k]) for k in EVIDENCE}
    facts = size | {k: e[k].cast("int") for k in FLAGS}
    facts |= {"artifacts": size["registry"] + size["paths"], "phases": F.col("low").rlike(PHASES).cast("int"), "emerging": F.col("emerging").isNotNull().cast("int"), "words": F.col("words"), "terms": F.col("terms")}
    said = {"events": F.array_join(e["events"], ", "), "emerging": F.col("emerging")}

    holds = [F.col("low").rlike(p) | (facts[enough[0]] >= enough[1] if enough else F.lit(False)) for _, _, p, enough, _ in CLASSES]
    picked = F.struct(F.lit(OTHERWISE[0]).alias("classification"), F.lit(OTHERWISE[1]).alias("kind"), F.lit(None).cast("string").alias("why"))
    for (name, kind, _, _, reason), hit in reversed(list(zip(CLASSES, holds, strict=True))):
        picked = F.when(hit, F.struct(F.lit(name).alias("classification"), F.lit(kind).alias("kind"), F.lit(reason).alias("why"))).otherwise(picked)
    points, why = _sum(SIMULATION, facts, said)
    raw = F.lit(BASE_SIMULATION) + points
    rows = rows.withColumn("picked", picked).withColumn("why1", why).withColumn("simulation", _round(F.least(F.lit(1.0), F.when(F.col("noise.hits") > 0, F.greatest(F.lit(0.1), raw - 0.05)).otherwise(raw))))
    facts["replay"] = F.floor(F.round(F.col("simulation") * 100, 6) + 0.5)
    points, why = _sum(QUALITY, facts, said)
    rows = rows.withColumn("why2", why).withColumn("score", _round(F.least(F.lit(1.0), F.lit(BASE_FEED if from_feed else BASE) + points)))

    total = reduce(lambda a, b: a + b, size.values())
    substantial = (size["commands"] > 0) | (size["registry"] > 0) | (size["events"] > 0) | e["cve"] | e["indicator"]
    anchor = substantial | e["technique"] | ((F.col("terms") >= 3) & (F.col("words") >= 350))
    # (holds, reason, class, kind, greatest score, simulation): the first that holds turns a row down at every level.
    out = [
        (F.col("bad_url").isNotNull(), F.col("bad_url"), "GENERIC_NEWS", "CAMPAIGN_INTEL", 0.1, 0.05, True),
        (F.col("shallow").isNotNull(), F.col("shallow"), "OTHER", "CAMPAIGN_INTEL", 0.3, 0.05, False),
        ((F.col("words") < min_words) & ~substantial, F.lit(f"Document too short (<{min_words} words) with zero technical evidence"), "OTHER", "VULNERABILITY_ADVISORY", 0.15, 0.05, True),
        (F.col("noise.pure") & (total == 0), F.lit("Commercial sales/marketing page with zero technical evidence"), "GENERIC_NEWS", "CAMPAIGN_INTEL", 0.18, 0.05, True),
        (~anchor, F.lit("Lacks actionable adversary emulation procedures, attack chains, or technical artifacts"), "GENERIC_NEWS", "CAMPAIGN_INTEL", 0.30, 0.1, False),
    ]
    score, simulation = F.col("score"), F.col("simulation")
    levels = F.struct(
        ((score >= min(min_score, 0.30)) | (simulation >= 0.40) | substantial).alias("permissive"),
        (((score >= min_score) | (simulation >= 0.50)) & (substantial | (F.col("terms") >= 2))).alias("balanced"),
        (((score >= 0.65) | (simulation >= 0.60)) & ((total >= 1) | (F.col("terms") >= 3))).alias("strict"),
    )
    none = F.struct(*[F.lit(False).alias(k) for k in ("permissive", "balanced", "strict")])
    made = F.struct(levels.cast(_RESULT).alias("qualified"), F.lit(None).cast("string").alias("rejection"), score.alias("score"), simulation.alias("simulation"), F.col("picked.classification").alias("classification"), F.col("picked.kind").alias("kind"), F.concat(F.array_compact(F.array("picked.why")), "why1", "why2").alias("reasons"))
    for hit, reason, name, kind, most, sim, exact in reversed(out):
        s = F.lit(most) if exact else F.least(score, F.lit(most))
        made = F.when(hit, F.struct(none.cast(_RESULT).alias("qualified"), F.concat(F.lit("REJECTED: "), reason).alias("rejection"), s.alias("score"), F.lit(sim).alias("simulation"), F.lit(name).alias("classification"), F.lit(kind).alias("kind"), F.array(reason).alias("reasons"))).otherwise(made)
    return rows.select(key, made.alias("m"), "evidence", F.col("noise.hits").alias("noise"), "emerging").select(key, "m.*", "evidence", "noise", "emerging")
