"""The library as a list: what its filters let through, its orders, names of document types, excerpts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T

# Names of document types as people write them.
TYPE_NAMES = {
    "advisory": ["THREAT_ADVISORY"],
    "advisories": ["THREAT_ADVISORY"],
    "threat-advisory": ["THREAT_ADVISORY"],
    "report": ["THREAT_REPORT"],
    "reports": ["THREAT_REPORT"],
    "threat": ["THREAT_REPORT"],
    "threat-report": ["THREAT_REPORT"],
    "incident": ["INCIDENT_REPORT", "DFIR_REPORT"],
    "dfir": ["DFIR_REPORT"],
    "malware": ["MALWARE_REPORT"],
    "vulnerability": ["VULNERABILITY_ADVISORY"],
    "vuln": ["VULNERABILITY_ADVISORY"],
    "cve": ["VULNERABILITY_ADVISORY"],
    "campaign": ["CAMPAIGN_REPORT"],
    "emulation": ["ADVERSARY_EMULATION_PLAN", "MICRO_EMULATION_PLAN"],
    "emulation-plan": ["ADVERSARY_EMULATION_PLAN"],
    "micro": ["MICRO_EMULATION_PLAN"],
    "micro-emulation": ["MICRO_EMULATION_PLAN"],
    "flow": ["ATTACK_FLOW"],
    "attack-flow": ["ATTACK_FLOW"],
    "atomic": ["ATOMIC_TEST"],
    "caldera": ["CALDERA_ABILITY"],
    "purple": ["PURPLE_TEAM_REPORT"],
    "purple-team": ["PURPLE_TEAM_REPORT"],
    "detection": ["DETECTION_RESEARCH"],
    "hunting": ["THREAT_HUNTING_REPORT"],
    "hunt": ["THREAT_HUNTING_REPORT"],
    "kev": ["KEV_ENTRY"],
    "group": ["MITRE_GROUP"],
    "mitre-group": ["MITRE_GROUP"],
    "software": ["MITRE_SOFTWARE"],
    "technique": ["MITRE_TECHNIQUE"],
}
TYPES = sorted({t for ts in TYPE_NAMES.values() for t in ts} | {"OTHER"})


def doc_types(value: str) -> list[str]:
    """The types that a name stands for: a friendly name, or a type's own in any case."""
    known = TYPE_NAMES.get(re.sub(r"[\s_]+", "-", value.strip().lower()))
    own = re.sub(r"[\s-]+", "_", value.strip().upper())
    return known or ([own] if own in TYPES else [])


@dataclass
class Choice:
    """What is chosen in the library: values by facet (none: all), a window of days, and flags."""

    facets: dict[str, list[str]] = field(default_factory=dict)
    since: str | None = None
    until: str | None = None
    least_quality: float = 0.0
    flags: list[str] = field(default_factory=list)


def chosen(c: Choice, facets: dict[str, Column], published: Column, quality: Column, flags: dict[str, Column]) -> Column:
    """Whether a row is among the choice. facets: of each an array column, a null or empty one
    with no values (a tier without a value is "unrated", which its column has to say);
    flags: conditions, of which all chosen ones have to hold. Rows without a day are in no window."""
    ok = F.lit(True)
    for name, wanted in c.facets.items():
        if wanted:
            values = F.transform(F.coalesce(facets[name], F.array().cast("array<string>")), lambda v: F.lower(v))
            ok &= F.arrays_overlap(values, F.array(*[F.lit(w.lower()) for w in wanted])) & (F.size(values) > 0)
    day = published.cast("date")
    if c.since:
        ok &= day >= F.lit(c.since).cast("date")
    if c.until:
        ok &= day <= F.lit(c.until).cast("date")
    if c.least_quality > 0:
        ok &= quality >= c.least_quality
    for name in c.flags:
        ok &= flags[name]
    return F.coalesce(ok, F.lit(False))


def library_order(by: str, c: dict[str, Column], key: str) -> list[Column]:
    """One of eight orders, ties by key. c: columns rank (of a search), published,
    ingested, grade and simulation, quality, n_iocs, n_techniques, words. Nothing
    comes before a value: undated and unranked rows are last."""
    down, zero = F.desc_nulls_last, lambda x: F.desc(F.coalesce(x, F.lit(0)))
    orders = {
        "relevance": [F.asc_nulls_last(c["rank"]), down(c["ingested"])],
        "published": [down(c["published"]), down(c["ingested"])],
        "emulation": [zero(c["grade"]), zero(c["simulation"]), down(c["published"])],
        "quality": [down(c["quality"])],
        "iocs": [zero(c["n_iocs"])],
        "techniques": [zero(c["n_techniques"])],
        "words": [zero(c["words"])],
        "newest": [down(c["ingested"])],
    }
    return [*orders[by], F.asc(key)]


#: Columns that a table is sorted by, and those of them that rise first.
COLUMN_SORTS = ("title", "publisher", "published", "type", "quality", "iocs", "techniques", "ai")
RISING = ("title", "publisher", "type")


def column_order(by: str, c: dict[str, Column], key: str, desc: bool | None = None) -> list[Column]:
    """A table's order by one of its columns, either way; text rises and numbers
    fall if desc is not given. Missing text counts as empty, missing numbers and
    days as nothing; ai is a rank of reviews and then their score."""
    desc = by not in RISING if desc is None else desc
    turn = F.desc if desc else F.asc
    if by in RISING:
        return [turn(F.lower(F.coalesce(c[by], F.lit("")))), F.asc(key)]
    if by == "published":
        return [turn(F.coalesce(c[by].cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))), F.asc(key)]
    parts = [c["ai"], c["ai_score"]] if by == "ai" else [c[by]]
    return [*[turn(F.coalesce(p, F.lit(0))) for p in parts], F.asc(key)]


def actor_order(by: str) -> list[Column]:
    """Actors by recent activity, reports, techniques or name; each with its own ties."""
    name = [F.lower("name"), F.col("name")]
    seen = F.desc_nulls_last("last_seen")
    return {
        "recent": [F.desc("activity"), seen, F.desc("attributed"), *name],
        "reports": [F.desc("reports"), seen, *name],
        "techniques": [F.desc("observed"), F.desc("attributed"), *name],
        "name": name,
    }[by]


def excerpt_around(text: Column, wanted: list[str], size: int = 260) -> Column:
    """A stretch of text about the first hit of the heaviest wanted term (an identifier
    before words, else the first that is met in the order of weight), cut at
    blanks, white space collapsed, with … where text is left out."""
    def weight(t: str) -> float:
        return 3.0 if re.match(T.EXACT_ID, t) else 0.3 if t in T.LOW_SIGNAL else 1.0

    terms = sorted(dict.fromkeys(wanted), key=lambda t: -weight(t))
    x = F.coalesce(text, F.lit(""))
    low = F.lower(x)
    at = F.coalesce(*[F.nullif(F.locate(t, low), F.lit(0)) for t in terms], F.lit(1)) - 1
    start = F.greatest(at - size // 3, F.lit(0))
    end = F.least(F.length(x), start + size)
    start = F.greatest(F.lit(0), F.least(start, end - size))
    cut = F.substr(x, start + 1, end - start)
    # Words cut in two at either end go, up to the hit.
    before, after = F.substr(x, start + 1, at - start), F.substr(x, at + 1, end - at)
    inside = (start > 0) & (start < at) & ~F.substr(x, F.greatest(start, F.lit(1)), F.lit(1)).rlike(r"\s")
    broken = (end < F.length(x)) & ~F.substr(x, end + 1, F.lit(1)).rlike(r"\s")
    head = F.when(inside, F.regexp_replace(before, r"^\S*\s?", "")).otherwise(before)
    tail = F.when(broken & after.rlike(r"\s"), F.regexp_replace(after, r"\s\S*$", "")).otherwise(after)
    body = F.trim(F.regexp_replace(F.when(F.length(cut) == 0, "").otherwise(F.concat(head, tail)), r"\s+", " "))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(x), "…").otherwise(""))


def unified(reports: DataFrame, cards: DataFrame, named: DataFrame, key: str = "id") -> DataFrame:
    """Reports, knowledge cards and identifiers that were asked for by name, in one list:
    of rows with one key the best stays, and an identifier goes where a
    report or card has its key. Each: (key, score, kind)."""
    both = reports.select(key, "score", "kind").unionByName(cards.select(key, "score", "kind"))
    best = both.groupBy(key).agg(F.max_by(F.struct("score", "kind"), F.struct("score", "kind")).alias("r")).select(key, "r.*")
    rest = named.select(key, "score", "kind").join(best.select(key), key, "left_anti").groupBy(key).agg(F.max("score").alias("score"), F.min("kind").alias("kind"))
    return best.unionByName(rest)
