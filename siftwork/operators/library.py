"""The report library: lookups, predicates, list views, orders, roll-ups and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def find(df: DataFrame, id_: str, wanted: str, shortest: int = 6) -> DataFrame:
    """The row of an id, or of the ids that start with a shortened one."""
    exact = F.col(id_) == wanted
    return df.where(exact | F.col(id_).startswith(wanted) if len(wanted) >= shortest else exact)


def found_by_url(df: DataFrame, url: str, wanted: str) -> DataFrame:
    """At most one row by its canonical address: of several, that with the least id."""
    return df.where(F.col(url) == wanted).orderBy(*df.columns).limit(1)


def visible(status: Column, kind: Column) -> Column:
    """Not hidden, no duplicate, and not from a structured source."""
    return ~F.coalesce(status, F.lit("")).isin("rejected", "duplicate") & ~F.coalesce(kind, F.lit("")).eqNullSafe(F.lit("structured_sync"))


def in_library(status: Column, kind: Column) -> Column:
    """Only acquired rows, or rows without a status, of an unstructured source."""
    return F.coalesce(status, F.lit("acquired")).isin("acquired") & ~F.coalesce(kind, F.lit("")).eqNullSafe(F.lit("structured_sync"))


def newest_first(published: str, ingested: str, key: str) -> list[Column]:
    """Publication order: day, undated rows last, then when it came in."""
    return [F.desc_nulls_last(F.to_date(published)), F.desc_nulls_last(ingested), F.asc(key)]


def by_keys(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """State rows of the wanted keys."""
    return state.join(keys.select(key).distinct(), key, "left_semi")


def phrase_or_tokens(fields: list[Column], narrow: list[Column], phrase: str, most: int = 6) -> Column:
    """The whole phrase in any field, or each of its first tokens in any narrow field."""
    low = phrase.lower()
    whole = F.lit(False)
    for f in fields:
        whole = whole | F.coalesce(F.lower(f).contains(low), F.lit(False))
    every = F.lit(True)
    for token in low.split()[:most]:
        some = F.lit(False)
        for f in narrow:
            some = some | F.coalesce(F.lower(f).contains(token), F.lit(False))
        every = every & some
    return whole | every


def list_filter(kinds: dict[str, tuple[Column, Column]], wanted: str, own: Column) -> Column:
    """A resource kind stands for its stored name, for classes that mean it, or for
    an array that isn't empty. kinds: kind to (is one of its classes, its array)."""
    of_class, array = kinds[wanted]
    return (own == wanted) | F.coalesce(of_class, F.lit(False)) | (F.size(F.coalesce(array, F.array().cast("array<string>"))) > 0)


def node_passes(kind: Column, reports: Column, last_seen: Column, tactics: Column, kinds: list[str], least: int, since: str | None, wanted: list[str]) -> Column:
    """Graph nodes by kind, reports, last sight, and for techniques by tactic."""
    out = kind.isin(*kinds) & (reports >= least)
    if since:
        out = out & (last_seen >= F.lit(since).cast("date"))
    if wanted:
        out = out & ((kind != "technique") | F.arrays_overlap(tactics, F.array(*[F.lit(x) for x in wanted])))
    return out


def edge_passes(confidence: Column, weight: Column, stated: Column, last_seen: Column, least_confidence: float, least: int, stated_only: bool, since: str | None) -> Column:
    """Graph edges by confidence, reports (beyond one), statement and last sight."""
    out = confidence >= least_confidence
    if least > 1:
        out = out & (weight >= least)
    if stated_only:
        out = out & (stated > 0)
    if since:
        out = out & (last_seen >= F.lit(since).cast("date"))
    return out


def slim(evidence: Column, indicators: Column) -> Column:
    """A list item's struct without evidence, its indicators without their context."""
    return F.struct(F.array().cast("array<string>").alias("evidence"), F.transform(indicators, lambda x: x.dropFields("evidence", "original")).alias("indicators"), F.size(evidence).alias("n_evidence"))


def list_item(json: Column, schema: str, text: Column) -> Column:
    """A stored row's JSON as a list item: its fields, number of indicators and excerpt."""
    r = F.from_json(json, schema)
    return F.struct(r.alias("fields"), F.coalesce(F.size(r["iocs"]), F.lit(0)).alias("ioc_count"), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 120).alias("excerpt"))


def name_search(nodes: DataFrame, name: str, reports: str, typed: str, limit: int = 12) -> DataFrame:
    """Nodes by name: exact 100, prefix 60, inside 30, plus log2(1 + reports)."""
    low, t = F.lower(name), typed.lower()
    base = F.when(low == t, 100.0).when(low.startswith(t), 60.0).when(low.contains(t), 30.0)
    return nodes.withColumn("score", base + F.log2(1 + F.col(reports))).where("score is not null").orderBy(F.desc("score"), name).limit(limit)


def alias_prefix(aliases: DataFrame, typed: str, weights: dict[str, float], limit: int = 10) -> DataFrame:
    """Entities by alias prefix (alias, id, kind): the best kind first, one row an entity."""
    kind = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    hit = aliases.where(F.lower("alias").startswith(typed.lower())).withColumn("w", F.coalesce(F.try_element_at(kind, F.col("kind")), F.lit(0.0)))
    one = hit.groupBy("id").agg(F.max("w").alias("w"), F.min_by("alias", F.struct(-F.col("w"), F.length("alias"), "alias")).alias("alias"))
    return one.orderBy(F.desc("w"), "alias", "id").limit(limit)


def frontier(urls: DataFrame, domain: str, priority: str, key: str, quota: int, busy: DataFrame, limit: int) -> DataFrame:
    """The next addresses: best first, quota of a domain, none of a busy one."""
    r = F.row_number().over(W.partitionBy(domain).orderBy(F.desc(priority), key))
    free = urls.join(busy.select(domain).distinct(), domain, "left_anti")
    return free.withColumn("_r", r).where(F.col("_r") <= quota).drop("_r").orderBy(F.desc(priority), key).limit(limit)


def merged_candidates(strategies: list[DataFrame], key: str, order: list[Column], limit: int) -> DataFrame:
    """Up to limit rows of each strategy, each row once with the first strategy that has it, twice limit in all."""
    parts = None
    for i, s in enumerate(strategies):
        p = s.orderBy(*order).limit(limit).withColumn("strategy", F.lit(i))
        parts = p if parts is None else parts.unionByName(p)
    rest = [c for c in parts.columns if c not in (key, "strategy")]
    one = parts.groupBy(key).agg(F.min_by(F.struct("strategy", *rest), "strategy").alias("r")).select(key, "r.*")
    return one.orderBy("strategy", *order).limit(2 * limit)


def unified(parts: dict[str, DataFrame], key: str, score: str) -> DataFrame:
    """Scored rows of several kinds as one list, best first."""
    out = None
    for kind, df in parts.items():
        p = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(score).cast("double").alias("score"))
        out = p if out is None else out.unionByName(p)
    return out.orderBy(F.desc("score"), "kind", "key")


def grouped_coverage(df: DataFrame, groups: dict[str, Column], who: str) -> DataFrame:
    """(grouping, value, n, kinds): rows and distinct who of each value of several
    groupings, array values one by one; all groupings in one pass."""

    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(name).alias("grouping"), x.alias("value")))

    entries = F.flatten(F.array(*[tagged(g, v) for g, v in groups.items()]))
    one = df.select(who, F.explode(entries).alias("e")).where("e.value is not null")
    return one.groupBy("e.grouping", "e.value").agg(F.count("*").alias("n"), F.countDistinct(who).alias("kinds"))


def actor_board(links: DataFrame, tools: DataFrame, top: int = 20, most_tools: int = 3) -> DataFrame:
    """(actor, reports, tools): distinct reports of an actor, and the tools that most of
    these name. links (actor, report); tools (report, tool)."""
    one = links.select("actor", "report").distinct()
    counts = one.groupBy("actor").agg(F.count("*").alias("reports"))
    used = one.join(tools.select("report", "tool").distinct(), "report").groupBy("actor", "tool").agg(F.count("*").alias("k"))
    r = F.row_number().over(W.partitionBy("actor").orderBy(F.desc("k"), "tool"))
    best = used.withColumn("r", r).where(F.col("r") <= most_tools).groupBy("actor").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tool"))), lambda x: x["tool"]).alias("tools"))
    none = F.array().cast("array<string>")
    return counts.orderBy(F.desc("reports"), "actor").limit(top).join(best, "actor", "left").select("actor", "reports", F.coalesce("tools", none).alias("tools"))


def tactic_steps(links: DataFrame, tactics: DataFrame, most: int = 3) -> DataFrame:
    """(tactic, reports, share, techniques): reports of a tactic, against the fullest
    tactic, and its most reported techniques. links (report, technique); tactics (technique, tactic)."""
    j = links.select("report", "technique").distinct().join(tactics, "technique")
    per = j.groupBy("tactic").agg(F.countDistinct("report").alias("reports"))
    best = j.groupBy("tactic", "technique").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(W.partitionBy("tactic").orderBy(F.desc("k"), "technique"))).where(F.col("r") <= most)
    names = best.groupBy("tactic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "technique"))), lambda x: x["technique"]).alias("techniques"))
    top = per.agg(F.max("reports").alias("top"))
    return per.join(names, "tactic").crossJoin(F.broadcast(top)).select("tactic", "reports", F.round(100 * F.col("reports") / F.col("top")).cast("int").alias("share"), "techniques")  # top: one row


def version_token(df: DataFrame, maxima: list[Column]) -> DataFrame:
    """One row that changes when the library does: a count and some maxima as text."""
    return df.agg(F.concat_ws("|", F.count("*").cast("string"), *[F.coalesce(F.max(c).cast("string"), F.lit("-")) for c in maxima]).alias("version"))


def funnel(items: DataFrame, job: str, stage: str, stages: list[str]) -> DataFrame:
    """One row a job with a counter for each stage."""
    return items.groupBy(job).agg(*[F.count_if(F.col(stage) == s).alias(s) for s in stages])


def mitigations(wanted: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """(mitigation, name, covered): mitigations of techniques, a child's own or else its
    parent's, by how many of the wanted they cover. links (technique, mitigation)."""
    own = wanted.select("technique").distinct().withColumn("parent", F.split("technique", r"\.")[0])
    m = links.groupBy("technique").agg(F.collect_set("mitigation").alias("ms"))
    a = own.join(m.withColumnRenamed("ms", "mine"), "technique", "left")
    b = a.join(m.select(F.col("technique").alias("parent"), F.col("ms").alias("theirs")), "parent", "left")
    each = b.select("technique", F.explode(F.coalesce("mine", "theirs")).alias("mitigation"))
    return each.groupBy("mitigation").agg(F.count("*").alias("covered")).join(names, "mitigation").select("mitigation", "name", "covered").orderBy(F.desc("covered"), "mitigation")


def campaigns_of_groups(campaigns: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, campaign): campaigns list the groups they are attributed to."""
    return campaigns.select("campaign", F.explode("groups").alias("group")).join(groups, "group").select("group", "campaign").distinct()


def replace_slice(stored: DataFrame, fresh: DataFrame, owner: str, source: str) -> DataFrame:
    """A whole index with one source's slice replaced; other sources' rows stay."""
    return stored.where(~F.col(owner).eqNullSafe(F.lit(source))).unionByName(fresh.where(F.col(owner) == source))


def upsert_edges(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("source", "target", "relationship")) -> DataFrame:
    """Edges by their three keys: the batch's values over the stored ones, one row each."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *rest)).alias("_r")).select(*keys, "_r.*")


def supersede(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows that a better copy replaces become duplicates that name it. pairs: (key, canonical)."""
    side = pairs.select(F.col(key).alias("_k"), F.col("canonical").alias("_c"))
    hit = F.col("_k").isNotNull()
    return df.join(side, F.col(key) == F.col("_k"), "left").select(*[c for c in df.columns if c != "status"], F.when(hit, "duplicate").otherwise(F.col("status")).alias("status"), F.col("_c").alias("canonical"))


def apply_version(df: DataFrame, update: DataFrame, key: str, fields: list[str], history: str, at: str) -> DataFrame:
    """New fields over old ones, and an entry of the old version in the row's history. update: (key, fields, at)."""
    side = update.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields], F.col(at).alias("_at"))
    hit = F.col("_k").isNotNull()
    entry = F.struct(F.col("version").alias("version"), F.col("_at").alias("at"))
    return df.join(side, F.col(key) == F.col("_k"), "left").select(
        key,
        *[F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(hit, F.concat(F.col(history), F.array(entry))).otherwise(F.col(history)).alias(history),
    )


def merged_sources(stored: DataFrame, seen: DataFrame, deep: DataFrame, curated: DataFrame, domain: str = "domain") -> DataFrame:
    """Discovered sources: stored ones, and those seen or met in depth, by domain, without
    the curated; counts are the larger, and status tells which qualify. Each: (domain, n); stored also trust."""
    both = stored.select(domain, F.col("n").alias("a"), "trust").join(seen.select(domain, F.col("n").alias("b")), domain, "full").join(deep.select(domain, F.col("n").alias("c")), domain, "full")
    n = F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.coalesce("c", F.lit(0)))
    out = both.join(curated.select(domain), domain, "left_anti").withColumn("n", n)
    status = F.when((F.col("n") >= 3) | (F.coalesce("trust", F.lit(0.0)) >= 0.9), "qualified").otherwise("candidate")
    return out.select(domain, "n", status.alias("status"))


def gate_view(text: Column, arrays: dict[str, Column], prefix: int = 800) -> list[Column]:
    """What a gate looks at: sizes of arrays that may be missing, and a text's start. The start is the view's feature."""
    return [*[F.greatest(F.size(F.coalesce(a, F.array())), F.lit(0)).alias(f"n_{k}") for k, a in arrays.items()], F.substring(F.coalesce(text, F.lit("")), 1, prefix).alias("head")]


def next_number(existing: Column, year: int) -> Column:
    """Aggregate: the next running number of a year, from ids like X-2024-0007."""
    n = F.regexp_extract(existing, rf"-{year}-(\d+)$", 1)
    return F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)) + 1


def list_order(by: str, columns: dict[str, Column], key: str) -> list[Column]:
    """One of the library's orders: a number or day falling, nulls last, or a name rising; ties by key."""
    c = columns[by]
    return [F.asc_nulls_last(F.lower(c)) if by == "name" else F.desc_nulls_last(c), F.asc(key)]


def previous_run(runs: DataFrame, group: str, number: str, status: str) -> DataFrame:
    """Adds previous: of each run the latest completed one of its group with a smaller number."""
    w = W.partitionBy(group).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("previous", F.max(F.when(F.col(status) == "completed", F.col(number))).over(w))


def kept_dates(day: Column, kind: Column, last: Column, since: str, until: str) -> Column:
    """A date window by kind: undated reports fail, groups, software and techniques
    pass, campaigns pass where their time overlaps it."""
    a, b = F.lit(since).cast("date"), F.lit(until).cast("date")
    return (
        F.when(kind.isin("group", "software", "technique"), True)
        .when(kind == "campaign", F.coalesce(day <= b, F.lit(True)) & F.coalesce(F.coalesce(last, day) >= a, F.lit(True)))
        .otherwise(F.coalesce(day.between(a, b), F.lit(False)))
    )


def depth_profile(items: DataFrame, domain: str, depth: str, value: str, top: int = 100) -> DataFrame:
    """Domains of items that were not found at the surface: count, least and greatest value (a shown list)."""
    g = items.where(F.col(depth) > 0).groupBy(domain).agg(F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))
    return g.orderBy(F.desc("n"), domain).limit(top)


def matrix_coverage(techniques: DataFrame, links: DataFrame, key: str = "technique") -> DataFrame:
    """One row: techniques, those that a report names, their share in percent, and reports that name any."""
    named = links.select(key, "report").join(techniques.select(key).distinct(), key)
    seen = named.agg(F.countDistinct(key).alias("covered"), F.countDistinct("report").alias("mapped_reports"))
    total = techniques.agg(F.countDistinct(key).alias("total"))
    share = F.coalesce(F.floor(F.try_divide(100 * F.col("covered"), F.col("total")) + 0.5), F.lit(0)).cast("int")
    return total.crossJoin(seen).select("total", "covered", share.alias("share"), "mapped_reports")  # one row each


def behaviours(evidence: DataFrame, key: str = "technique") -> DataFrame:
    """(technique, observed, inferred, mapped, reports, status, first_seen): counts by label, the
    strongest status, distinct reports and the first sight. evidence: (technique, label, report, seen)."""
    rank = F.when(F.col("label") == "observed", 3).when(F.col("label") == "inferred", 2).otherwise(1)
    n = lambda label: F.count_if(F.col("label") == label).alias(label)
    return evidence.groupBy(key).agg(n("observed"), n("inferred"), n("mapped"), F.countDistinct("report").alias("reports"), F.max_by("label", rank).alias("status"), F.min("seen").alias("first_seen"))


def insights(nodes: DataFrame, top: int = 6) -> DataFrame:
    """(kind, rank, node, score, n): the top nodes of each kind, and how many it has. nodes: (node, kind, score)."""
    r = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "node"))
    n = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    return nodes.withColumn("rank", r).where(F.col("rank") <= top).join(n, "kind").select("kind", "rank", "node", "score", "n")


def gate_pass(rows: DataFrame, reason: Column, version: str, current: int) -> tuple[DataFrame, DataFrame]:
    """A gate over stale rows only: rows with their new status, and counts by reason."""
    old = F.col(version).isNull() | (F.col(version) != current)
    judged = rows.where(old).withColumn("reason", reason)
    out = judged.withColumn("status", F.when(F.col("reason").isNotNull(), "rejected").otherwise("acquired"))
    return out, out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def defensive_quotes(evidence: DataFrame, key: str, text: str, at: str, most: int = 12, shortest: int = 25) -> DataFrame:
    """Quotes for recommendations: long enough, each wording once with its first place, the first most of each key (a shown list)."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    one = evidence.where(F.length(F.trim(text)) >= shortest).groupBy(key, low.alias("_w")).agg(F.min_by(text, at).alias(text), F.min(at).alias(at))
    r = F.row_number().over(W.partitionBy(key).orderBy(at, "_w"))
    return one.withColumn("rank", r).where(F.col("rank") <= most).select(key, "rank", text)


def thinnest_queries(queries: DataFrame, counts: DataFrame, slots: int, turn: int) -> DataFrame:
    """Half the slots to the categories with the fewest documents, one query each, the
    rest to the others in turn. queries: (category, query); counts: (category, n)."""
    one = queries.groupBy("category").agg(F.sort_array(F.collect_list("query")).alias("qs"))  # a list of queries is short
    one = one.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pick = F.element_at("qs", (F.lit(turn) % F.size("qs") + 1).cast("int"))
    thin = one.orderBy("n", "category").limit(slots // 2).select("category", pick.alias("query"), F.lit("thin").alias("why"))
    rest = one.join(thin.select("category"), "category", "left_anti").orderBy(F.crc32(F.concat_ws(":", F.lit(turn), "category").cast("binary")), "category").limit(slots - slots // 2)
    return thin.union(rest.select("category", pick.alias("query"), F.lit("turn").alias("why")))


def normal_name(name: Column) -> Column:
    """An entity's name for comparing: lower case, one kind of quote and dash, single blanks."""
    c = F.translate(F.lower(F.trim(name)), "’‘“”–—‐‑", "''\"\"----")
    return F.regexp_replace(c, r"\s+", " ")


def tactic_of(value: Column, tactics: dict[str, tuple[str, list[str]]]) -> Column:
    """A tactic's name from its id or from an alias within the text, the first that fits. tactics: id to (name, aliases)."""
    low = F.lower(F.coalesce(value, F.lit("")))
    out = F.lit(None).cast("string")
    for id_, (name, aliases) in reversed(tactics.items()):
        hit = low.contains(id_.lower())
        for a in aliases:
            hit = hit | low.contains(a)
        out = F.when(hit, name).otherwise(out)
    return out


def technique_of(value: Column) -> Column:
    """"T1059: name" as struct(id, name); other texts have no id."""
    id_ = F.regexp_extract(value, r"^\s*(T\d{4}(?:\.\d{3})?)", 1)
    rest = F.trim(F.regexp_replace(value, r"^\s*T\d{4}(?:\.\d{3})?\s*[:–-]?\s*", ""))
    return F.struct(F.nullif(id_, F.lit("")).alias("id"), F.nullif(rest, F.lit("")).alias("name"))


def backfill(months: Column, now: str, most: int = 36) -> Column:
    """A bounded plan: struct(since, pages, links) for so many months back."""
    m = F.greatest(F.lit(1), F.least(months, F.lit(most)))
    return F.struct(F.add_months(F.lit(now).cast("date"), -m).alias("since"), F.least(5 + 2 * m, F.lit(40)).alias("pages"), F.least(50 * m, F.lit(1000)).alias("links"))
