"""Rule-based decisions on addresses, texts and runs, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions.text import CVE, DIGEST, IPV4, let

# Frequent words by which Latin-script languages are told apart.
MARKERS = {
    "en": "the of and to in is that for it with as was on are by this".split(),
    "de": "der die das und ist nicht ein eine mit von zu auf für den dem".split(),
    "fr": "le la les des et est une dans pour que qui sur pas avec du".split(),
    "es": "el la los las de y que en un una por con para es del".split(),
    "it": "il lo gli di che è per una con del della sono non nel".split(),
    "nl": "de het een van en is niet dat op te voor met zijn aan".split(),
    "pt": "o a os as de que e do da em um uma para com não".split(),
}
SCRIPTS = [("ja", r"[぀-ヿ]"), ("ko", r"[가-힯]"), ("zh", r"[一-鿿]"), ("ar", r"[؀-ۿ]"), ("uk", r"[іїєґ]"), ("ru", r"[Ѐ-ӿ]")]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def marker_hits(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(MARKERS[lang])))


def _matching(words: Column, pattern: str) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike(pattern)))


def detect_language(text: Column, declared: Column) -> Column:
    """English by its share of frequent words; other scripts by their letters; Latin
    languages by at least 12 hits of 4 words, half more than English; else what
    is declared, else und."""

    def decide(w: Column) -> Column:
        n = F.size(w)
        en = marker_hits(w, "en")
        out = F.when((n >= 40) & (en >= 0.12 * n), F.lit("en"))
        for lang, letters in SCRIPTS:
            out = out.when(_matching(w, letters) >= F.greatest(F.lit(3), 0.2 * n), F.lit(lang))
        for lang in ("de", "fr", "es", "nl", "it", "pt"):
            hits = marker_hits(w, lang)
            kinds = marker_hits(F.array_distinct(w), lang)
            rival = F.greatest(*[marker_hits(w, o) for o in MARKERS if o not in (lang, "en")])
            out = out.when((hits >= 12) & (kinds >= 4) & (hits > 1.5 * en) & (hits >= rival), F.lit(lang))
        return out.otherwise(F.coalesce(F.nullif(F.lower(F.substring(declared, 1, 2)), F.lit("")), F.lit("und")))

    return let(words_of(text), decide)


def candidate_url(url: Column, from_feed: Column) -> Column:
    """Why an address is no article: not_web, file, utility, index or shallow; null if it may be one."""
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://[^/]*", ""))
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return (
        F.when(url.isNull() | ~url.rlike(r"^https?://[^/]+"), "not_web")
        .when(path.rlike(r"\.(?:png|jpe?g|gif|svg|css|js|zip|exe|mp4|woff2?)$"), "file")
        .when(path.rlike(r"/(?:login|signin|register|cart|checkout|contact|privacy|terms|careers?|jobs|search|account)(?:/|$)"), "utility")
        .when(path.rlike(r"/(?:tags?|categor(?:y|ies)|authors?|archives?|page)(?:/|$)"), "index")
        .when(~from_feed & (depth < 1), "shallow")
    )


def in_scope(url: Column, patterns: Column) -> Column:
    """Whether an address is under any of the patterns (host with subdomains, and a path
    start), given as text split by commas, semicolons or lines; no pattern allows all."""
    bare = F.regexp_replace(F.lower(url), r"^https?://(?:www\.)?", "")
    host, path = F.regexp_extract(bare, "^([^/?#]*)", 1), F.regexp_extract(bare, "^[^/?#]*(/[^?#]*)?", 1)
    items = F.filter(F.transform(F.split(F.coalesce(patterns, F.lit("")), r"[,;\n]"), lambda p: F.regexp_replace(F.lower(F.trim(p)), r"^(?:https?://)?(?:\*\.)?(?:www\.)?|\*+$", "")), lambda p: p != "")

    def fits(p: Column) -> Column:
        h, r = F.regexp_extract(p, "^([^/]*)", 1), F.regexp_extract(p, "^[^/]*(/.*)?$", 1)
        return ((host == h) | host.endswith(F.concat(F.lit("."), h))) & path.startswith(r)

    return (F.size(items) == 0) | F.exists(items, fits)


def domain_trust(domain: Column) -> Column:
    """0..1 by the kind of domain; the first rule that fits."""
    d = F.lower(domain)
    return (
        F.when(d.rlike(r"(?:^|\.)(?:gov|mil)(?:\.[a-z]{2})?$"), 0.98)
        .when(d.rlike(r"(?:^|\.)(?:cert|csirt)[.-]"), 0.95)
        .when(d.rlike(r"(?:^|\.)edu(?:\.[a-z]{2})?$|\.ac\.[a-z]{2}$"), 0.85)
        .when(d.rlike(r"(?:security|threat|labs?|research)"), 0.8)
        .when(d.rlike(r"(?:news|press|journal)"), 0.6)
        .when(d.rlike(r"\.(?:top|xyz|click|club|online|site)$"), 0.2)
        .otherwise(0.5)
    )


def technical_depth(techniques: Column, indicators: Column, commands: Column, actors: Column, behaviours: Column, detections: Column, exploited_cve: Column) -> Column:
    """Capped weighted sum, 0..125."""
    capped = lambda c, w, most: F.least(c * w, F.lit(most))
    return (
        capped(techniques, 6, 30) + capped(indicators, 2, 25) + capped(commands, 4, 20) + capped(actors, 3, 10) + capped(behaviours, 3, 25) + capped(detections, 5, 15)
        + F.when(exploited_cve, 15).otherwise(0)
    )


def relevance(title: Column, summary: Column, url: Column, wanted: list[str], unwanted: list[str], accepted: Column, decided: Column, tier: Column, has_entity: Column) -> Column:
    """0..1 before anything is fetched: words for and against (in the summary half as
    much), identifiers, the source's record (Laplace) and its tier."""
    t, s = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(summary, F.lit("")))
    good = sum((F.when(t.contains(w) | s.contains(w), 1).otherwise(0) for w in wanted), F.lit(0))
    bad = sum((F.when(t.contains(w), 1.0).when(s.contains(w), 0.5).otherwise(0.0) for w in unwanted), F.lit(0.0))
    both = F.concat_ws(" ", t, s)
    score = (
        F.lit(0.35)
        + F.when(has_entity, 0.3).otherwise(0.0)
        + F.when(both.rlike(CVE), 0.22).otherwise(0.0)
        + F.when(both.rlike(r"\bt\d{4}(?:\.\d{3})?\b"), 0.2).otherwise(0.0)
        + F.least(F.lit(0.34), 0.12 * good)
        - 0.25 * bad
        + F.when(F.lower(url).rlike("/(?:research|threat|blog|analysis)/"), 0.05).when(F.lower(url).rlike("/(?:careers|events|webinar|product)"), -0.15).otherwise(0.0)
        + 0.2 * ((F.coalesce(accepted, F.lit(0)) + 1) / (F.coalesce(decided, F.lit(0)) + 2) - 0.5)
        + F.when(tier <= 2, 0.1).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


#: Patterns of a taxonomy that make up one expression.
MOST_SIGNALS = 2000


def taxonomy(docs: DataFrame, signals: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text", most: int = 4, share: float = 0.3) -> DataFrame:
    """(key, category, score, rank): signals (category, pattern, weight, cap, threshold)
    counted in the text up to cap, thrice in the title; categories over their
    threshold and share of the best one's ratio. signals: a short table, whose patterns
    become one expression: texts are looked at where they lie, nothing is joined or shuffled."""
    listed: dict[str, list] = {}
    rows = signals.orderBy("category", "pattern").limit(MOST_SIGNALS + 1).collect()
    if len(rows) > MOST_SIGNALS:
        raise ValueError(f"a taxonomy of over {MOST_SIGNALS} patterns is matched by phrases.find()")
    for r in rows:
        listed.setdefault(r.category, []).append(r)
    t, x = F.lower(F.coalesce(F.col(title), F.lit(""))), F.lower(F.coalesce(F.col(text), F.lit("")))
    each = []
    for category, signs in listed.items():
        hits = [F.lit(float(s.weight)) * (F.least(F.regexp_count(x, F.lit(s.pattern)), F.lit(s.cap)) + 3 * F.regexp_count(t, F.lit(s.pattern))) for s in signs]
        score = reduce(lambda a, b: a + b, hits)
        threshold = float(max(s.threshold for s in signs))
        each.append(F.struct((-score / threshold).alias("_r"), F.lit(category).alias("category"), score.alias("score"), F.lit(threshold).alias("_t")))
    none = "array<struct<_r:double,category:string,score:double,_t:double>>"
    kept = F.array_sort(F.filter(F.array(*each).cast(none), lambda c: c["score"] >= c["_t"]))
    one = docs.select(key, kept.alias("c")).select(key, F.filter("c", lambda c: -c["_r"] >= -share * F.col("c")[0]["_r"]).alias("c"))
    out = one.select(key, F.posexplode(F.slice("c", 1, most)).alias("p", "c"))
    return out.select(key, "c.category", "c.score", (F.col("p") + 1).alias("rank"))


def protected_tokens(text: Column) -> Column:
    """Distinct identifiers that a rewrite must keep: ids, digests, addresses, defanged names."""
    pattern = rf"(?i)\b(?:{CVE}|T\d{{4}}(?:\.\d{{3}})?|{DIGEST}|{IPV4}|hxxps?://\S+|[a-z0-9-]+\[\.\][a-z0-9.\[\]-]+)"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def citations(answer: Column, n_sources: Column) -> Column:
    """Numbers in [S1, S2] groups, those known and those not."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(F.regexp_extract_all(answer, F.lit(r"\[S\d+(?:\s*[,;]\s*S?\d+)*\]"), F.lit(0)), " "), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))
    return F.struct(F.filter(found, lambda x: x.between(1, n_sources)).alias("known"), F.filter(found, lambda x: ~x.between(1, n_sources)).alias("unknown"))


def uncited_claims(answer: Column) -> Column:
    """Sentences of over 60 characters without a citation."""
    return F.filter(F.split(answer, r"(?<=[.!?])\s+"), lambda s: (F.length(s) > 60) & ~s.rlike(r"\[S\d+"))


def conversational(message: Column) -> Column:
    """Turns that need no search: greetings, thanks, or next to nothing."""
    m = F.lower(F.trim(message))
    return (F.length(m) <= 4) | m.rlike(r"^(?:hi|hello|hey|thanks?|thank you|ok(?:ay)?|bye|good (?:morning|evening)|merci|danke|gracias)\b[\s!.,]*$")


def resource_kind(classification: Column, techniques: Column, indicators: Column, cves: Column) -> Column:
    """A stored kind is missing: by its class's words, then by what was found."""
    c = F.lower(F.coalesce(classification, F.lit("")))
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    return (
        F.when(c.contains("advisor"), "advisory").when(c.contains("malware"), "malware_analysis").when(c.contains("detection"), "detection").when(c.contains("vulnerab") | some(cves), "vulnerability")
        .when(some(techniques), "ttp_report").when(some(indicators), "ioc_feed").otherwise("article")
    )


def tags(*parts: Column, most: int = 15) -> Column:
    """Ordered distinct values of arrays, blanks out, most of them at most (a shown list)."""
    return F.slice(F.array_distinct(F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda x: F.trim(x) != "")), 1, most)


def redact_config(config: Column) -> Column:
    """A map with the values of secret-looking keys masked."""
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).rlike("secret|token|password|api_?key|credential"), F.lit("***")).otherwise(v))


def display_id(prefix: str, value: Column) -> Column:
    """A short stable code for showing; not a key."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.lpad(F.hex(F.crc32(value.cast("binary"))), 8, "0")))


def hung(started: Column, beat: Column, now: str, beat_minutes: int = 10, most_hours: int = 6) -> Column:
    """Why a job counts as hung: no_heartbeat or too_long; null if it doesn't."""
    at = F.unix_timestamp(F.lit(now).cast("timestamp"))
    return F.when(at - F.unix_timestamp(beat) > beat_minutes * 60, "no_heartbeat").when(at - F.unix_timestamp(started) > most_hours * 3600, "too_long")


def findings(steps: DataFrame, before: DataFrame | None = None, key: str = "technique_id") -> DataFrame:
    """(key, points, severity, trend): missed 2 or logged 1, plus priority and risk; and
    how the step did in the run before. steps: (key, outcome, priority, risk)."""
    rank = F.when(F.col("outcome") == "missed", 0).when(F.col("outcome") == "logged", 1).when(F.col("outcome") == "detected", 2).otherwise(3)
    s = steps.where("outcome in ('missed', 'logged')").withColumn("points", F.when(F.col("outcome") == "missed", 2).otherwise(1) + F.col("priority") + F.col("risk")).withColumn("_r", rank)
    severity = F.when(F.col("points") >= 6, "critical").when(F.col("points") >= 4, "high").when(F.col("points") >= 3, "medium").otherwise("low")
    if before is None:
        return s.select(key, "points", severity.alias("severity"), F.lit("new").alias("trend"))
    b = before.select(key, rank.alias("_b"))
    trend = F.when(F.col("_b").isNull(), "new").when(F.col("_b") > F.col("_r"), "regressed").when(F.col("_b") < F.col("_r"), "improved").otherwise("open")
    return s.join(b, key, "left").select(key, "points", severity.alias("severity"), trend.alias("trend"))


def vulnerability_rollup(hits: DataFrame, named: list[str], top: int = 50) -> DataFrame:
    """(cve, score, reports): half the score of each of its top reports, 20 if it is named. hits: (cve, report, score)."""
    r = F.row_number().over(W.partitionBy("cve").orderBy(F.desc("score"), "report"))
    s = hits.withColumn("_r", r).groupBy("cve").agg(F.sum(F.when(F.col("_r") <= top, F.col("score") * 0.5).otherwise(0.0)).alias("score"), F.count("*").alias("reports"))
    return s.withColumn("score", F.col("score") + F.when(F.col("cve").isin(named) if named else F.lit(False), 20).otherwise(0))


def next_window(cursor: Column, now: str, days: int = 60, years: int = 3) -> Column:
    """The next slice of an archive going back: struct(since, until); after years it starts anew."""
    today = F.lit(now).cast("date")
    until = F.when(cursor.isNull() | (cursor <= F.add_months(today, -12 * years)), today).otherwise(cursor)
    return F.struct(F.date_sub(until, days).alias("since"), until.alias("until"))


def gaps(observed: Column, indicators: Column, detections: Column, newest_days: Column) -> Column:
    """What an advisory lacks, as an array of reasons."""
    g = F.array(
        F.when(observed == 0, "no observed behaviour"), F.when(indicators == 0, "no indicators"), F.when(detections == 0, "no detections"), F.when(newest_days > 365, "sources older than a year")
    )
    return F.array_compact(g)
