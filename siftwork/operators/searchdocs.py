"""Search documents: reports and knowledge cards in one schema, and what a query means in it.

A report's entities, techniques, tactics and identifiers come from its stored
lists, its evidence and its text; a card's from the knowledge tables. What a
query names is looked up in the same tables, so filters and boosts follow from
the documents and need not be handed in.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import engine as en
from siftwork.operators import listing as ls
from siftwork.operators import phrases as ph
from siftwork.operators import search as sr

#: kind, id, name, via (the name that the document uses most), count, rel (self, mention or uses).
ENTITY = "struct<kind:string,id:string,name:string,via:string,count:bigint,rel:string>"
SCHEMA = (
    f"id string, kind string, title string, summary string, body string, aliases array<string>, entities array<{ENTITY}>, techniques array<string>, technique_rel string, tactics array<string>, cves array<string>, doc_types array<string>, "
    "tier int, confidence double, quality double, published_at date, publisher string, url string, has_iocs boolean, has_emulation boolean, has_evidence boolean, dup_key string, actor_names array<string>"
)
COLUMNS = [c.strip().split(" ")[0] for c in re.split(r", (?=[a-z_]+ )", SCHEMA)]
# What stands for no name, identifiers, the card's publisher and the kinds of documents that emulate.
NONE = r"(?i)^(?:none(?: identified)?|unknown|n/a|-|not specified)$"
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
PUBLISHER = "MITRE ATT&CK"
EMULATION = ["ADVERSARY_EMULATION_PLAN", "MICRO_EMULATION_PLAN", "ATTACK_FLOW", "ATOMIC_TEST", "CALDERA_ABILITY", "PURPLE_TEAM_REPORT"]
#: What a structured record of an entity counts beside its mentions.
OWN = 10


def _squeezed(c: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def first_sentences(c: Column, most: int = 420) -> Column:
    """The start of a text, cut behind a sentence if one ends past its first quarter or so."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    head = F.substring(flat, 1, most)
    whole = F.regexp_extract(head, r"^([\s\S]*\.) ", 1)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.when(F.length(whole) > 121, whole).otherwise(F.rtrim(head)), F.lit("…")))


def entity_mentions(reports: DataFrame, stated: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(report, kind, id, name, via, count) of entities that a report's stored names
    resolve to (1 each, whatever their case), that its record is about (OWN), or that
    title and text mention by an alias of three letters or more, in whole words and, where the
    alias is letters only, in its case. via: the alias met most often, else the
    stored name. reports: (id, title, text); stated: (report, kind, value) with kinds
    of entities, or "record" for the id of one; entities: (kind, id, name); aliases:
    (kind, id, alias), names included."""
    names = stated.where(~F.trim("value").rlike(NONE)).select("report", "kind", F.lower(F.trim("value")).alias("low"), F.trim("value").alias("value"))
    names = names.groupBy("report", "kind", "low").agg(F.min("value").alias("value"))
    known = aliases.select("kind", "id", F.lower("alias").alias("low")).distinct()
    listed = names.where("kind <> 'record'").join(known, ["kind", "low"]).select("report", "kind", "id", F.col("value").alias("alias"), F.lit(1).alias("n"), F.lit(False).alias("text"))
    own = names.where("kind = 'record'").select("report", F.col("value").alias("id")).join(entities, "id").select("report", "kind", "id", F.col("name").alias("alias"), F.lit(OWN).alias("n"), F.lit(False).alias("text"))
    said = aliases.where(F.length("alias") >= 3).withColumn("ref", F.struct("kind", "id", "alias"))
    body = reports.select(F.col("id").alias("report"), F.concat_ws("\n", "title", "text").alias("body"))
    exact = ph.find(body, said.where(F.col("alias").rlike("^[A-Za-z]+$")).select(F.col("alias").alias("phrase"), F.col("ref").alias("id")), "report", "body", form=ph.bounded)
    loose = ph.find(body, said.where(~F.col("alias").rlike("^[A-Za-z]+$")).select(F.col("alias").alias("phrase"), F.col("ref").alias("id")), "report", "body", form=lambda c: F.lower(ph.bounded(c)))
    met = exact.unionByName(loose).select("report", "id.kind", "id.id", "id.alias", F.col("n").cast("int").alias("n"), F.lit(True).alias("text"))
    each = listed.unionByName(own).unionByName(met)
    # The most frequent alias of the text, else of what is stored; ties by the alphabet.
    via = F.min_by("alias", F.struct((~F.col("text")).alias("later"), (-F.col("n")).alias("fewer"), "alias"))
    out = each.groupBy("report", "kind", "id").agg(via.alias("via"), F.sum("n").alias("count"))
    return out.join(entities.select("kind", "id", "name"), ["kind", "id"])


def report_docs(reports: DataFrame, stated: DataFrame, entities: DataFrame, aliases: DataFrame, techniques: DataFrame) -> DataFrame:
    """One search document per report. reports: id, title, text, and of excerpt, url,
    canonical_url, publisher, source_name, published_at, quality, tier, confidence,
    doc_types, n_iocs, n_evidence, n_emulation, text_hash those that there are; stated:
    (report, kind, value) of stored lists: entity kinds, record, technique, tactic, cve;
    techniques: (id, tactics). Reports without any of these keep empty lists."""
    def has(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in reports.columns else F.lit(None).cast(kind)

    found = entity_mentions(reports, stated.where(~F.col("kind").isin("technique", "tactic", "cve")), entities, aliases)
    one = F.struct((-F.col("count")).alias("o"), "kind", "id", F.struct("kind", "id", "name", "via", "count", F.lit("mention").alias("rel")).alias("e"))
    listed = found.groupBy("report").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("entities"))
    ids = reports.select(F.col("id").alias("report"), F.explode(F.regexp_extract_all("text", F.lit(TECHNIQUE), F.lit(0))).alias("value"))
    named = stated.where("kind = 'technique'").select("report", F.regexp_extract(F.upper("value"), r"T\d{4}(?:\.\d{3})?", 0).alias("value"))
    tech = ids.unionByName(named).distinct().join(techniques.select(F.col("id").alias("value"), "tactics"), "value")
    tactics = tech.select("report", F.explode("tactics").alias("tactic")).unionByName(stated.where("kind = 'tactic' AND value <> ''").select("report", F.col("value").alias("tactic")))
    cve = reports.select(F.col("id").alias("report"), F.explode(F.regexp_extract_all("text", F.lit(CVE), F.lit(0))).alias("value"))
    cve = cve.unionByName(stated.where(F.col("kind") == "cve").where(F.trim("value").rlike(f"(?i)^{CVE[4:]}$")).select("report", F.trim("value").alias("value"))).select("report", F.upper("value").alias("value"))
    group = lambda df, c, name: df.groupBy("report").agg(F.array_sort(F.collect_set(c)).alias(name))
    out = reports.select("*", F.col("id").alias("report"))
    for side in (listed, group(tech, "value", "techniques"), group(tactics, "tactic", "tactics"), group(cve, "value", "cves")):
        out = out.join(side, "report", "left")
    # Groups by name, and stored actors that no table knows.
    actors = stated.where(F.col("kind").isin("group", "campaign") & ~F.trim("value").rlike(NONE)).select("report", F.trim("value").alias("value"), F.lower(F.trim("value")).alias("low"))
    strange = actors.join(aliases.where(F.col("kind").isin("group", "campaign")).select(F.lower("alias").alias("low")).distinct(), "low", "left_anti")
    out = out.join(group(strange, "value", "strange"), "report", "left")
    text = F.coalesce("text", has("excerpt", "string"), F.lit(""))
    none, no = F.array().cast("array<string>"), F.array().cast(f"array<{ENTITY}>")
    types = F.coalesce(has("doc_types", "array<string>"), none)
    quality = has("quality", "double")
    of_groups = F.transform(F.filter(F.coalesce("entities", no), lambda e: e["kind"] == "group"), lambda e: e["name"])
    return out.select(
        F.col("id").cast("string").alias("id"),
        F.lit("report").alias("kind"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled report")).alias("title"),
        _squeezed(F.coalesce(F.nullif(has("excerpt", "string"), F.lit("")), F.substring(text, 1, 600)), 600).alias("summary"),
        text.alias("body"),
        none.alias("aliases"),
        F.coalesce("entities", no).alias("entities"),
        F.coalesce("techniques", none).alias("techniques"),
        F.lit("mention").alias("technique_rel"),
        F.coalesce("tactics", none).alias("tactics"),
        F.coalesce("cves", none).alias("cves"),
        types.alias("doc_types"),
        has("tier", "int").alias("tier"),
        has("confidence", "double").alias("confidence"),
        F.when(quality > 1, quality / 100).otherwise(quality).alias("quality"),
        has("published_at", "date").alias("published_at"),
        F.coalesce(F.nullif(has("publisher", "string"), F.lit("")), has("source_name", "string"), F.lit("")).alias("publisher"),
        F.coalesce(F.nullif(has("canonical_url", "string"), F.lit("")), has("url", "string"), F.lit("")).alias("url"),
        (F.coalesce(has("n_iocs", "int"), F.lit(0)) > 0).alias("has_iocs"),
        (F.arrays_overlap(types, F.array(*map(F.lit, EMULATION))) | (F.coalesce(has("n_emulation", "int"), F.lit(0)) > 0)).alias("has_emulation"),
        (F.coalesce(has("n_evidence", "int"), F.lit(0)) > 0).alias("has_evidence"),
        F.coalesce(F.nullif(has("text_hash", "string"), F.lit("")), has("canonical_url", "string")).alias("dup_key"),
        F.array_distinct(F.concat(of_groups, F.coalesce("strange", none))).alias("actor_names"),
    )


def knowledge_docs(cards: DataFrame, links: DataFrame, techniques: DataFrame) -> DataFrame:
    """One search document per group, software, campaign and technique. cards: (kind, id,
    name, description, aliases); links: (id, other) between cards, in either direction;
    and (id, technique) rows of links for what they use; techniques: (id, name, tactics,
    platforms, components)."""
    names = cards.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("name").alias("other_name"))
    both = links.select("id", "other").unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    used = both.join(names, "other")
    entity = F.struct(F.col("other_kind").alias("kind"), F.col("other").alias("id"), F.col("other_name").alias("name"), F.col("other_name").alias("via"), F.lit(0).cast("bigint").alias("count"), F.lit("uses").alias("rel"))
    # A group's software before its campaigns, and so on: by kind and id.
    uses = used.groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col("other_kind"), F.col("other"), entity.alias("e")))), lambda x: x["e"]).alias("uses"))
    tech = links.join(techniques.select(F.col("id").alias("other"), "tactics"), "other").groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("techniques"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tactics")))).alias("tactics"))
    none, no = F.array().cast("array<string>"), F.array().cast(f"array<{ENTITY}>")
    own = F.struct("kind", "id", "name", F.col("name").alias("via"), F.lit(OWN).cast("bigint").alias("count"), F.lit("self").alias("rel"))
    c = cards.join(uses, "id", "left").join(tech, "id", "left")
    said = F.transform(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(CVE), F.lit(0)), F.upper)
    plain = [F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("quality"), F.lit(None).cast("date").alias("published_at"), F.lit(PUBLISHER).alias("publisher")]
    rest = [F.lit(False).alias("has_iocs"), F.lit(False).alias("has_emulation"), F.lit(False).alias("has_evidence"), F.lit(None).cast("string").alias("dup_key")]
    folder = F.create_map(*[F.lit(x) for x in ("group", "groups", "software", "software", "campaign", "campaigns")])
    a = c.select(
        "id",
        "kind",
        F.col("name").alias("title"),
        first_sentences(F.col("description")).alias("summary"),
        F.coalesce("description", F.lit("")).alias("body"),
        F.concat(F.array("name"), F.coalesce("aliases", none), F.array("id")).alias("aliases"),
        F.concat(F.array(own), F.coalesce("uses", no)).alias("entities"),
        F.coalesce("techniques", none).alias("techniques"),
        F.lit("uses").alias("technique_rel"),
        F.coalesce("tactics", none).alias("tactics"),
        F.when(F.col("kind") == "campaign", F.array_distinct(said)).otherwise(none).alias("cves"),
        F.array(F.concat(F.lit("MITRE_"), F.upper("kind"))).alias("doc_types"),
        *plain,
        F.concat(F.lit("https://attack.mitre.org/"), folder[F.col("kind")], F.lit("/"), "id", F.lit("/")).alias("url"),
        *rest,
        F.when(F.col("kind") == "group", F.array("name")).otherwise(none).alias("actor_names"),
    )
    joined = lambda x: F.array_join(F.coalesce(x, none), ", ")
    part = lambda label, x: F.when(F.size(F.coalesce(x, none)) > 0, F.concat(F.lit(f"{label}: "), joined(x), F.lit(".")))
    sub = F.when(F.col("name").contains(": "), F.array(F.regexp_replace("name", r"^[\s\S]*?: ", ""))).otherwise(none)
    b = techniques.select(
        "id",
        F.lit("technique").alias("kind"),
        F.col("name").alias("title"),
        F.concat_ws(" — ", F.nullif(F.array_join(F.coalesce("tactics", none), " · "), F.lit("")), F.nullif(joined(F.col("platforms")), F.lit(""))).alias("summary"),
        F.concat_ws(" ", F.concat("id", F.lit(" "), "name", F.lit(".")), part("Tactics", F.col("tactics")), part("Platforms", F.col("platforms")), part("Data components", F.col("components"))).alias("body"),
        F.concat(F.array("id"), sub).alias("aliases"),
        no.alias("entities"),
        F.array("id").alias("techniques"),
        F.lit("self").alias("technique_rel"),
        F.coalesce("tactics", none).alias("tactics"),
        none.alias("cves"),
        F.array(F.lit("MITRE_TECHNIQUE")).alias("doc_types"),
        *plain,
        F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace("id", F.lit("."), F.lit("/")), F.lit("/")).alias("url"),
        *rest,
        none.alias("actor_names"),
    )
    return a.unionByName(b)


# ---- What a query means -----------------------------------------------------


@dataclass
class Meaning:
    """Entities (kind, id), techniques, tactics and CVE ids that a query's words name, and the words left over."""

    entities: list[tuple[str, str]] = field(default_factory=list)
    techniques: list[str] = field(default_factory=list)
    tactics: list[str] = field(default_factory=list)
    cves: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def meaning(spark: SparkSession, words: list[str], aliases: DataFrame, techniques: DataFrame, synonyms: DataFrame, tactics: list[str], most: int = 6) -> Meaning:
    """Identifiers first; then, left to right and longest first at each word, an
    entity's alias (whatever its case, two of one name at most), a technique's name, shorthand
    or cover, or a tactic (a single word of six letters or more). All names are
    looked up in one job each, over the query's runs of words."""
    out, rest = Meaning(), []
    for w in words:
        bare = re.sub(r"[.,;:!?]+$", "", w)
        if re.fullmatch(r"(?i)CVE-\d{4}-\d{4,7}", bare):
            out.cves.append(bare.upper())
        elif re.fullmatch(r"(?i)T\d{4}(?:\.\d{3})?", bare):
            out.techniques.append(bare.upper())
        else:
            rest.append(w)
            continue
        rest.append(None)  # a run of words never crosses an identifier
    n = len(rest)
    runs = {(i, k): " ".join(rest[i : i + k]) for i in range(n) for k in range(1, min(most, n - i) + 1) if None not in rest[i : i + k]}
    if runs:
        asked = spark.createDataFrame([(r,) for r in sorted(set(runs.values()))], "phrase string")
        known: dict[str, list[tuple[str, str]]] = {}
        same = asked.join(aliases, F.lower("phrase") == F.lower("alias")).select("phrase", "kind", "id").distinct()
        for r in same.orderBy("phrase", "kind", "id").collect():  # a query's runs
            known.setdefault(r.phrase, []).append((r.kind, r.id))
        named: dict[str, list[str]] = {}
        for r in ph.match_phrases(asked, techniques, synonyms).orderBy("phrase", "id").collect():  # a query's runs
            named.setdefault(r.phrase, []).append(r.id)
        stage = {r.phrase: r.tactic for r in ph.match_tactics(asked, tactics).collect()}  # a query's runs
        i = 0
        while i < n:
            step = 1
            for k in range(min(most, n - i), 0, -1):
                said = runs.get((i, k))
                if said in known:
                    out.entities += known[said][:2]
                elif said in named:
                    out.techniques += named[said]
                elif said in stage and (k > 1 or len(said) >= 6):
                    out.tactics.append(stage[said])
                else:
                    continue
                step = k
                break
            else:
                if rest[i] is not None:
                    out.words.append(rest[i])
            i += step
    for name in ("entities", "techniques", "tactics", "cves"):
        setattr(out, name, list(dict.fromkeys(getattr(out, name))))
    return out


def _of(kind: str, i: str) -> Column:
    return F.filter("entities", lambda e: (e["kind"] == kind) & (e["id"] == i))


def relation(techniques: Column, t: str) -> Column:
    """exact, sub or parent: how a document's techniques have one; null if they don't."""
    kin = F.exists(techniques, lambda x: x == t.split(".")[0]) if "." in t else F.exists(techniques, lambda x: x.startswith(t + "."))
    return F.when(F.array_contains(techniques, t), "exact").when(kin, "parent" if "." in t else "sub")


#: Points for a technique that a document of a kind names itself, or a relative of; fixed values.
TECHNIQUE_POINTS = {"technique": (8.0, 2.0), "report": (3.0, 1.5), "other": (0.6, 0.3)}
#: Points for an entity that a card uses; fixed value.
USES = 0.8


def meant_boosts(docs: DataFrame, m: Meaning, intent: list[str] | None = None) -> DataFrame:
    """(id, boost, parts) of search documents by what a query means, from their own lists.
    intent: document types that its words ask for."""
    parts: dict[str, Column] = {}
    for kind, i in m.entities:
        mine = _of(kind, i)
        count = F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, e: a + e["count"])
        titled = F.exists(mine, lambda e: F.lower("title").contains(F.lower(e["via"])) | F.lower("title").contains(F.lower(e["name"])))
        own, used = _has_rel(mine, "self"), _has_rel(mine, "uses")
        parts[f"{kind} {i}"] = F.when(own, en.BOOSTS["entity_self"]).when(used, USES).otherwise(en.mention_boost(count, titled & (count > 0)))
    for t in m.techniques:
        how = relation(F.col("techniques"), t)
        points = F.lit(0.0)
        for kind, (exact, near) in TECHNIQUE_POINTS.items():
            mine = ~F.col("kind").isin("technique", "report") if kind == "other" else F.col("kind") == kind
            points = F.when(mine & (how == "exact"), exact).when(mine & how.isNotNull(), near).otherwise(points)
        parts[t] = points
    for t in m.tactics:
        parts[t] = F.when(_lowered("tactics", t), en.BOOSTS["tactic"]).otherwise(0.0)
    for c in m.cves:
        parts[c] = F.when(F.array_contains("cves", c), en.BOOSTS["cve"]).otherwise(0.0)
    if intent:
        parts["document type"] = F.when(F.arrays_overlap("doc_types", F.array(*map(F.lit, intent))), en.BOOSTS["intent"]).otherwise(0.0)
    if not parts:
        return docs.select("id", F.lit(0.0).alias("boost"), F.array().cast("array<struct<part:string,add:double>>").alias("parts"))
    return en.boosts(docs, "id", parts)


def _has_rel(entities: Column, rel: str) -> Column:
    return F.exists(entities, lambda e: e["rel"] == rel)


def _lowered(column: str, value: str) -> Column:
    return F.exists(column, lambda x: F.lower(x) == value.lower())


#: Fields of a query that name an entity, and the kinds that they look among.
ENTITY_FIELDS = {"actor": ("group", "campaign"), "malware": ("software",), "campaign": ("campaign",)}
FLAGS = {"iocs": "has_iocs", "emulation": "has_emulation", "evidence": "has_evidence"}


def hard_filter(q: sr.Query, aliases: DataFrame, techniques: DataFrame, synonyms: DataFrame, tactics: list[str]) -> tuple[Column, list[str]]:
    """Whether a search document passes all of a query's conditions, and what of them
    was not understood. Entities, techniques and tactics are looked up by
    name; an entity that no table knows is sought in the text. Reports need a day for a
    date window, cards pass it."""
    spark, warnings, f = aliases.sparkSession, list(q.warnings), q.filters
    flat = T.flatten_text(F.concat_ws(" ", "title", "aliases", "summary", "body"))
    ok = F.lit(True)

    def both(hit: Column, negated: bool) -> None:
        nonlocal ok
        ok &= ~F.coalesce(hit, F.lit(False)) if negated else F.coalesce(hit, F.lit(False))

    named = [(kind, v, no) for kind in ENTITY_FIELDS for v, no in f.get(kind, [])]
    known: dict[tuple[str, str], str] = {}
    if named:
        rows = aliases.where(F.lower("alias").isin([v.lower() for _, v, _ in named])).groupBy("kind", F.lower("alias").alias("low")).agg(F.min("id").alias("id"))
        known = {(r.kind, r.low): r.id for r in rows.collect()}  # a query's names
    for name, v, no in named:
        hit = next(((k, known[k, v.lower()]) for k in ENTITY_FIELDS[name] if (k, v.lower()) in known), None)
        both(F.size(_of(*hit)) > 0 if hit else flat.contains(v.lower()), no)
    said = [v for v, _ in f.get("technique", []) if not re.fullmatch(r"(?i)t\d{4}(?:\.\d{3})?", v)]
    ids = {}
    if said:
        asked = spark.createDataFrame([(v,) for v in said], "phrase string")
        ids = {r.phrase: r.id for r in ph.match_phrases(asked, techniques, synonyms).groupBy("phrase").agg(F.min("id").alias("id")).collect()}  # a query's names
    for v, no in f.get("technique", []):
        t = v.upper() if v not in said else ids.get(v)
        if t:
            both(relation(F.col("techniques"), t).isNotNull(), no)
        else:
            warnings.append(f"technique:{v} is not known")
    if f.get("tactic"):
        words = {v: v.replace("-", " ").replace("_", " ") for v, _ in f["tactic"]}
        asked = spark.createDataFrame([(w,) for w in words.values()], "phrase string")
        stage = {r.phrase: r.tactic for r in ph.match_tactics(asked, tactics).collect()}  # a query's names
        for v, no in f["tactic"]:
            if words[v] in stage:
                both(_lowered("tactics", stage[words[v]]), no)
            else:
                warnings.append(f"tactic:{v} is not known")
    for v, no in f.get("cve", []):
        c = f"CVE-{v}" if re.fullmatch(r"\d{4}-\d{4,7}", v) else v.upper()
        if re.fullmatch(r"CVE-\d{4}-\d{4,7}", c):
            both(F.array_contains("cves", c), no)
        else:
            warnings.append(f"cve:{v} is no identifier")
    for name, of in (("type", ls.doc_types), ("tier", lambda v: [int(v)] if v in ("1", "2", "3", "4") else [])):
        wanted, denied = [], []
        for v, no in f.get(name, []):
            (denied if no else wanted).extend(of(v))
            if not of(v):
                warnings.append(f"{name}:{v} is not known")
        for values, no in ((wanted, False), (denied, True)):
            if values:
                both(F.arrays_overlap("doc_types", F.array(*map(F.lit, values))) if name == "type" else F.col("tier").isin(values), no)
    low = F.lower("publisher")
    for no in (False, True):
        values = [v.lower() for name in ("publisher", "source") for v, n in f.get(name, []) if n == no]
        if values:
            both(functools.reduce(lambda a, v: a | low.contains(v), values, F.lit(False)), no)
    for v, no in f.get("has", []):
        if v.lower() in FLAGS:
            both(F.col(FLAGS[v.lower()]), no)
        else:
            warnings.append(f"has:{v} is not known")
    if q.since or q.until:
        day = F.col("published_at").cast("string")
        ok &= (F.col("kind") != "report") | F.coalesce(day.between(q.since or "0000", q.until or "9999"), F.lit(False))
    bare = sr.Query(q.clauses, phrases=q.phrases, excluded=q.excluded)
    return ok & sr.passes(bare, {}, flat), warnings
