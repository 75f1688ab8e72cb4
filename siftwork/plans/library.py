"""Queries over the report library's operators; documents, orders and events stand for reports and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators import library as lb
from siftwork.plans.catalog import query
from siftwork.session import table as t


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reports: a quarter structured, some hidden, some undated."""
    i = F.col("doc_id")
    return t(spark, d, "documents").select(
        "doc_id", "lang", "source", "n_chars", "text", F.concat(F.lit("rpt_"), F.lpad(i.cast("string"), 8, "0")).alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), i).alias("url"),
        F.when(i % 10 == 3, "rejected").when(i % 10 == 7, "duplicate").when(i % 5 == 0, F.lit(None)).otherwise("acquired").alias("status"), F.when(i % 4 == 1, "structured_sync").otherwise("web").alias("kind"),
        F.when(i % 6 != 2, F.date_add(F.lit("2024-01-01").cast("date"), (i % 97).cast("int"))).alias("published"), (i * 7 % 1000).alias("ingested"),
    )


_R = """r AS (SELECT doc_id, lang, source, n_chars, text, 'rpt_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, 'https://' || source || '.example.org/' || doc_id AS url,
CASE WHEN doc_id % 10 = 3 THEN 'rejected' WHEN doc_id % 10 = 7 THEN 'duplicate' WHEN doc_id % 5 = 0 THEN NULL ELSE 'acquired' END AS status, CASE WHEN doc_id % 4 = 1 THEN 'structured_sync' ELSE 'web' END AS kind,
CASE WHEN doc_id % 6 <> 2 THEN DATE '2024-01-01' + CAST(doc_id % 97 AS INT) END AS published, doc_id * 7 % 1000 AS ingested FROM documents)"""


@query(f"""WITH {_R} SELECT id, n_chars FROM r WHERE starts_with(id, 'rpt_000000')""")
def report_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lb.find(_reports(spark, d), "id", "rpt_000000").select("id", "n_chars")


@query(f"""WITH {_R} SELECT id, url FROM r WHERE url = 'https://src0.example.org/0'""")
def report_by_url(spark: SparkSession, d: str) -> DataFrame:
    return lb.found_by_url(_reports(spark, d).select("id", "url"), "url", "https://src0.example.org/0")


@query(f"""WITH {_R} SELECT doc_id FROM r WHERE coalesce(status, '') NOT IN ('rejected', 'duplicate') AND kind <> 'structured_sync' ORDER BY published DESC NULLS LAST, ingested DESC, doc_id LIMIT 6""")
def recent_reports(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).where(lb.visible(F.col("status"), F.col("kind")))
    return r.orderBy(*lb.newest_first("published", "ingested", "doc_id")).limit(6).select("doc_id")


@query(f"""WITH {_R} SELECT doc_id, l.quality FROM r LEFT JOIN labels l USING (doc_id) WHERE coalesce(status, 'acquired') = 'acquired' AND kind <> 'structured_sync' ORDER BY published DESC NULLS LAST, ingested DESC, doc_id LIMIT 2000""")
def library_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The newest 2000 reports of the library; the bound is the feature."""
    r = _reports(spark, d).where(lb.in_library(F.col("status"), F.col("kind"))).join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return r.orderBy(*lb.newest_first("published", "ingested", "doc_id")).limit(2000).select("doc_id", "quality")


@query(f"""WITH {_R} SELECT doc_id, url, sha256(text) AS sha, quality FROM r LEFT JOIN labels USING (doc_id)""")
def dedup_index(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).select("doc_id", "url", F.sha2("text", 256).alias("sha"))
    return r.join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("""SELECT event_id, value FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def fetch_states(spark: SparkSession, d: str) -> DataFrame:
    keys = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    return lb.by_keys(t(spark, d, "events"), keys, "user_id").select("event_id", "value")


@query(f"""WITH {_R} SELECT doc_id FROM r WHERE contains(lower(text), 'the and') OR contains(lower(url), 'the and') OR ((contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'and') OR contains(lower(source), 'and')))""")
def phrase_or_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).where(lb.phrase_or_tokens([F.col("text"), F.col("url")], [F.col("text"), F.col("source")], "The and")).select("doc_id")


@query(f"""WITH {_R} SELECT doc_id FROM r WHERE kind = 'advisory' OR lang = 'de' OR n_chars % 3 = 0""")
def listed_kind(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"advisory": (F.col("lang") == "de", F.when(F.col("n_chars") % 3 == 0, F.array("source")))}
    return _reports(spark, d).where(lb.list_filter(kinds, "advisory", F.col("kind"))).select("doc_id")


_G = """n AS (SELECT l_suppkey AS node, CASE WHEN l_suppkey % 2 = 0 THEN 'technique' ELSE 'actor' END AS kind, count(DISTINCT l_orderkey) AS reports, max(CAST(l_shipdate AS DATE)) AS last, list(DISTINCT l_returnflag) AS tactics FROM lineitem GROUP BY 1)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_suppkey") % 2 == 0, "technique").otherwise("actor").alias("kind")
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), kind).agg(F.countDistinct("l_orderkey").alias("reports"), F.max(F.to_date("l_shipdate")).alias("last"), F.collect_set("l_returnflag").alias("tactics"))


@query(f"""WITH {_G} SELECT node, kind, reports FROM n WHERE reports >= 3 AND last >= DATE '1998-06-01' AND (kind <> 'technique' OR list_contains(tactics, 'R'))""")
def graph_nodes_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where(lb.node_passes(F.col("kind"), F.col("reports"), F.col("last"), F.col("tactics"), ["actor", "technique"], 3, "1998-06-01", ["R"])).select("node", "kind", "reports")


@query("""SELECT a, b, weight FROM (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS weight, max(l_discount) AS c, count(*) FILTER (WHERE l_returnflag = 'R') AS s, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1, 2) WHERE c >= 0.03 AND weight >= 2 AND s > 0 AND last >= DATE '1996-01-01'""")
def graph_edges_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.count("*").alias("weight"), F.max("l_discount").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("s"), F.max(F.to_date("l_shipdate")).alias("last"))
    return e.where(lb.edge_passes(F.col("c"), F.col("weight"), F.col("s"), F.col("last"), 0.03, 2, True, "1996-01-01")).select("a", "b", "weight")


@query("""SELECT l_orderkey, len(list(l_partkey)) AS n_evidence, list_sort(list(l_partkey)) AS indicators FROM lineitem GROUP BY 1""")
def slim_items(spark: SparkSession, d: str) -> DataFrame:
    ind = F.sort_array(F.collect_list(F.struct(F.col("l_partkey").alias("value"), F.col("l_returnflag").alias("evidence"), F.col("l_linestatus").alias("original"))))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(ind.alias("ind"))
    s = g.select("l_orderkey", lb.slim(F.transform("ind", lambda x: x["evidence"]), F.col("ind")).alias("s"))
    return s.select("l_orderkey", "s.n_evidence", F.transform("s.indicators", lambda x: x["value"]).alias("indicators"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 0 AS ioc_count, substr(trim(regexp_replace(event_type || '  item', '\\s+', ' ', 'g')), 1, 120) AS excerpt FROM events""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    i = lb.list_item(F.col("props"), "k bigint, iocs array<string>", F.concat("event_type", F.lit("  item")))
    return t(spark, d, "events").select("event_id", i.alias("i")).select("event_id", "i.fields.k", F.greatest("i.ioc_count", F.lit(0)).alias("ioc_count"), "i.excerpt")


@query(f"""WITH {_R} SELECT doc_id, row_number() OVER (ORDER BY published DESC NULLS LAST, ingested DESC, doc_id) AS place FROM r QUALIFY place <= 500""")
def publication_order(spark: SparkSession, d: str) -> DataFrame:
    top = _reports(spark, d).orderBy(*lb.newest_first("published", "ingested", "doc_id")).limit(500)  # a shown page
    from pyspark.sql import Window as W

    return top.select("doc_id", F.row_number().over(W.orderBy(*lb.newest_first("published", "ingested", "doc_id"))).alias("place"))


@query(f"""WITH {_G} SELECT CAST(node AS VARCHAR) AS name, reports, CASE WHEN CAST(node AS VARCHAR) = '1' THEN 100.0 WHEN starts_with(CAST(node AS VARCHAR), '1') THEN 60.0 ELSE 30.0 END + log2(1 + reports) AS score FROM n WHERE contains(CAST(node AS VARCHAR), '1') ORDER BY score DESC, name LIMIT 12""")
def node_search(spark: SparkSession, d: str) -> DataFrame:
    return lb.name_search(_nodes(spark, d).select(F.col("node").cast("string").alias("name"), "reports"), "name", "reports", "1")


@query("""WITH a AS (SELECT p_name AS alias, p_brand AS id, CASE WHEN p_size % 3 = 0 THEN 'group' WHEN p_size % 3 = 1 THEN 'software' ELSE 'other' END AS kind FROM part WHERE starts_with(lower(p_name), 'co')), w AS (SELECT *, CASE kind WHEN 'group' THEN 3.0 WHEN 'software' THEN 2.0 ELSE 0.0 END AS w FROM a)
SELECT id, max(w) AS w, arg_min(alias, (-w, length(alias), alias)) AS alias FROM w GROUP BY 1 ORDER BY w DESC, alias, id LIMIT 10""")
def entity_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "group").when(F.col("p_size") % 3 == 1, "software").otherwise("other")
    a = t(spark, d, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("id"), kind.alias("kind"))
    return lb.alias_prefix(a, "Co", {"group": 3.0, "software": 2.0})


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, length(url) AS priority FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) AS r FROM p WHERE host NOT IN (SELECT host FROM p WHERE page_id % 40 = 0))
SELECT page_id, host, priority FROM r WHERE r <= 2 ORDER BY priority DESC, page_id LIMIT 30""")
def frontier_next(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.length("url").alias("priority"))
    return lb.frontier(p, "host", "priority", "page_id", 2, p.where("page_id % 40 = 0"), 30)


@query(f"""WITH {_R}, a AS (SELECT doc_id, n_chars, 0 AS strategy FROM r WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 40), b AS (SELECT doc_id, n_chars, 1 AS strategy FROM r WHERE source = 'src0' ORDER BY n_chars DESC, doc_id LIMIT 40), c AS (SELECT doc_id, n_chars, 2 AS strategy FROM r ORDER BY n_chars DESC, doc_id LIMIT 40)
SELECT doc_id, min(strategy) AS strategy, any_value(n_chars) AS n_chars FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1 ORDER BY 2, 3 DESC, 1 LIMIT 80""")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).select("doc_id", "n_chars", "lang", "source")
    parts = [r.where("lang = 'en'"), r.where("source = 'src0'"), r]
    return lb.merged_candidates([p.select("doc_id", "n_chars") for p in parts], "doc_id", [F.desc("n_chars"), F.asc("doc_id")], 40)


@query("""SELECT 'report' AS kind, CAST(doc_id AS VARCHAR) AS key, CAST(n_chars AS DOUBLE) AS score FROM documents UNION ALL SELECT 'knowledge', CAST(p_partkey AS VARCHAR), p_retailprice FROM part UNION ALL SELECT 'cve', CAST(s_suppkey AS VARCHAR), s_acctbal FROM supplier""")
def unified_list(spark: SparkSession, d: str) -> DataFrame:
    parts = {"report": ("documents", "doc_id", "n_chars"), "knowledge": ("part", "p_partkey", "p_retailprice"), "cve": ("supplier", "s_suppkey", "s_acctbal")}
    return lb.unified({k: t(spark, d, n).select(F.col(i).alias("i"), F.col(s).alias("s")) for k, (n, i, s) in parts.items()}, "i", "s")


@query("""SELECT 'lang' AS grouping, lang AS value, count(*) AS n, count(DISTINCT source) AS kinds FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'tier', CAST(n_chars % 4 AS VARCHAR), count(*), count(DISTINCT source) FROM documents GROUP BY n_chars % 4
UNION ALL SELECT 'size', v, count(*), count(DISTINCT source) FROM (SELECT source, unnest(CASE WHEN n_chars > 2000 THEN ['any', 'long'] ELSE ['any'] END) AS v FROM documents) GROUP BY v""")
def grouped_coverage(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("n_chars") > 2000, F.array(F.lit("any"), F.lit("long"))).otherwise(F.array(F.lit("any")))
    return lb.grouped_coverage(t(spark, d, "documents"), {"lang": F.array("lang"), "tier": F.array((F.col("n_chars") % 4).cast("string")), "size": size}, "source")


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS actor, l_orderkey AS report FROM lineitem), c AS (SELECT actor, count(*) AS reports FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), x AS (SELECT DISTINCT l_orderkey AS report, CAST(l_partkey % 30 AS VARCHAR) AS tool FROM lineitem),
u AS (SELECT actor, tool, count(*) AS k FROM o JOIN x USING (report) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY k DESC, tool) AS r FROM u) SELECT c.actor, any_value(c.reports) AS reports, list(tool ORDER BY r) AS tools FROM c JOIN b ON c.actor = b.actor AND r <= 3 GROUP BY 1""")
def dashboard_actors(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    return lb.actor_board(li.select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("report")), li.select(F.col("l_orderkey").alias("report"), (F.col("l_partkey") % 30).cast("string").alias("tool")))


@query("""WITH j AS (SELECT DISTINCT l_orderkey AS report, l_partkey AS technique, p_brand AS tactic FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT tactic, count(DISTINCT report) AS reports FROM j GROUP BY 1),
b AS (SELECT tactic, technique, row_number() OVER (PARTITION BY tactic ORDER BY count(*) DESC, technique) AS r FROM j GROUP BY 1, 2) SELECT p.tactic, any_value(p.reports) AS reports, CAST(floor(100 * any_value(p.reports) / (SELECT CAST(max(reports) AS DOUBLE) FROM p) + 0.5) AS INT) AS share, list(technique ORDER BY r) AS techniques FROM p JOIN b ON p.tactic = b.tactic AND r <= 3 GROUP BY 1""")
def dashboard_tactics(spark: SparkSession, d: str) -> DataFrame:
    links = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("technique"))
    return lb.tactic_steps(links, t(spark, d, "part").select(F.col("p_partkey").alias("technique"), F.col("p_brand").alias("tactic")))


@query("""SELECT CAST(count(*) AS VARCHAR) || '|' || CAST(max(doc_id) AS VARCHAR) || '|' || CAST(max(n_chars) AS VARCHAR) || '|' || max(lang) || '|' || max(source) AS version FROM documents""")
def library_version(spark: SparkSession, d: str) -> DataFrame:
    return lb.version_token(t(spark, d, "documents"), [F.col(c) for c in ("doc_id", "n_chars", "lang", "source")])


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1""")
def job_funnel(spark: SparkSession, d: str) -> DataFrame:
    return lb.funnel(t(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase", "error"])


@query("""WITH w AS (SELECT DISTINCT 'T' || (l_partkey % 60) || CASE WHEN l_linenumber % 2 = 0 THEN '.001' ELSE '' END AS technique FROM lineitem), l AS (SELECT DISTINCT 'T' || (p_partkey % 60) || CASE WHEN p_size % 5 = 0 THEN '.001' ELSE '' END AS technique, p_brand AS mitigation FROM part),
e AS (SELECT technique, mitigation FROM w JOIN l USING (technique) UNION ALL SELECT w.technique, mitigation FROM w JOIN l ON l.technique = split_part(w.technique, '.', 1) WHERE w.technique NOT IN (SELECT technique FROM l)) SELECT mitigation, 'use ' || mitigation AS name, count(*) AS covered FROM e GROUP BY 1""")
def mitigations_ranked(spark: SparkSession, d: str) -> DataFrame:
    child = lambda c: F.when(c, ".001").otherwise("")
    wanted = t(spark, d, "lineitem").select(F.concat(F.lit("T"), F.col("l_partkey") % 60, child(F.col("l_linenumber") % 2 == 0)).alias("technique"))
    links = t(spark, d, "part").select(F.concat(F.lit("T"), F.col("p_partkey") % 60, child(F.col("p_size") % 5 == 0)).alias("technique"), F.col("p_brand").alias("mitigation")).distinct()
    names = links.select("mitigation", F.concat(F.lit("use "), "mitigation").alias("name")).distinct()
    return lb.mitigations(wanted, links, names)


@query("""SELECT DISTINCT s_suppkey AS "group", l_orderkey AS campaign FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0""")
def campaigns_by_group(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("campaign")).agg(F.collect_set("l_suppkey").alias("groups"))
    return lb.campaigns_of_groups(c, t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("group")))


@query("""SELECT doc_id, source, 'old' AS stamp FROM documents WHERE source <> 'src0' UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source = 'src0' AND n_chars > 500""")
def replaced_slice(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return lb.replace_slice(docs.select("doc_id", "source", F.lit("old").alias("stamp")), docs.where("n_chars > 500").select("doc_id", "source", F.lit("new").alias("stamp")), "source", "src0")


@query("""WITH s AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relationship, max(l_quantity) AS weight FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3), b AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relationship, max(l_quantity) AS weight FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2, 3)
SELECT coalesce(s.source, b.source) AS source, coalesce(s.target, b.target) AS target, coalesce(s.relationship, b.relationship) AS relationship, coalesce(b.weight, s.weight) AS weight FROM s FULL JOIN b ON s.source = b.source AND s.target = b.target AND s.relationship = b.relationship""")
def edges_upserted(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relationship"), F.col("l_quantity").alias("weight"), "l_linestatus", "l_linenumber")
    return lb.upsert_edges(e.where("l_linestatus = 'F'").drop("l_linestatus", "l_linenumber"), e.where("l_linenumber = 1").drop("l_linestatus", "l_linenumber"))


@query("""WITH c AS (SELECT md5(text) AS m, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, CASE WHEN c.canonical <> doc_id THEN 'duplicate' ELSE 'acquired' END AS status, CASE WHEN c.canonical <> doc_id THEN c.canonical END AS canonical FROM documents LEFT JOIN c ON md5(text) = c.m""")
def superseded_copies(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("m"))
    first = docs.groupBy("m").agg(F.min("doc_id").alias("canonical"))
    pairs = docs.join(first, "m").where("canonical <> doc_id").select("doc_id", "canonical")
    return lb.supersede(docs.select("doc_id", F.lit("acquired").alias("status")), pairs, "doc_id")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS version, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS n_history FROM documents LEFT JOIN labels USING (doc_id)""")
def versions_applied(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "n_chars", F.lit(1).alias("version"), F.array().cast("array<struct<version:int,at:string>>").alias("history"))
    update = docs.join(t(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit("2024-01-31").alias("at"))
    return lb.apply_version(docs, update, "doc_id", ["n_chars"], "history", "at").select("doc_id", "n_chars", "version", F.size("history").alias("n_history"))


@query("""WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, page_id FROM pages), a AS (SELECT domain, count(*) FILTER (WHERE page_id % 3 = 0) AS n, max(CASE WHEN page_id % 20 = 0 THEN 0.95 ELSE 0.1 END) AS trust FROM h GROUP BY 1), b AS (SELECT domain, count(*) AS n FROM h GROUP BY 1), c AS (SELECT domain, count(*) AS n FROM h WHERE page_id % 2 = 0 GROUP BY 1)
SELECT domain, greatest(a.n, b.n, coalesce(c.n, 0)) AS n, CASE WHEN greatest(a.n, b.n, coalesce(c.n, 0)) >= 3 OR a.trust >= 0.9 THEN 'qualified' ELSE 'candidate' END AS status FROM a JOIN b USING (domain) LEFT JOIN c USING (domain) WHERE domain NOT LIKE '%.org'""")
def discovered_sources(spark: SparkSession, d: str) -> DataFrame:
    h = t(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("domain"), "page_id")
    stored = h.groupBy("domain").agg(F.count_if(F.col("page_id") % 3 == 0).alias("n"), F.max(F.when(F.col("page_id") % 20 == 0, 0.95).otherwise(0.1)).alias("trust"))
    count = lambda x: x.groupBy("domain").agg(F.count("*").alias("n"))
    return lb.merged_sources(stored, count(h), count(h.where("page_id % 2 = 0")), h.where("domain like '%.org'").select("domain").distinct())


@query("""SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS n_iocs, substr(coalesce(text, ''), 1, 800) AS head FROM documents""")
def gate_views(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", *lb.gate_view(F.col("text"), {"iocs": F.when(F.col("n_chars") % 2 == 0, F.array("source"))}))


@query("""SELECT CAST(max(CASE WHEN year(o_orderdate) = 1997 THEN o_orderkey END) AS INT) + 1 AS number FROM orders""")
def next_advisory_number(spark: SparkSession, d: str) -> DataFrame:
    ids = t(spark, d, "orders").select(F.concat(F.lit("ADV-"), F.year("o_orderdate"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"))
    return ids.agg(lb.next_number(F.col("id"), 1997).alias("number"))


@query(f"""WITH {_R} SELECT count(*) FILTER (WHERE v) AS visible, count(*) FILTER (WHERE v AND doc_id % 3 = 0) AS current, count(*) FILTER (WHERE v AND n_chars > 1000) AS analysed FROM (SELECT *, coalesce(status, '') NOT IN ('rejected', 'duplicate') AND kind <> 'structured_sync' AS v FROM r)""")
def extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    v = lb.visible(F.col("status"), F.col("kind"))
    return _reports(spark, d).agg(F.count_if(v).alias("visible"), F.count_if(v & (F.col("doc_id") % 3 == 0)).alias("current"), F.count_if(v & (F.col("n_chars") > 1000)).alias("analysed"))


@query("""SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages""")
def known_urls(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()


@query(f"""WITH {_R}, a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS words, row_number() OVER (ORDER BY lower(source), doc_id) AS name, row_number() OVER (ORDER BY published DESC NULLS LAST, doc_id) AS published FROM r)
SELECT 'words' AS by, doc_id, words AS place FROM a WHERE words <= 100 UNION ALL SELECT 'name', doc_id, name FROM a WHERE name <= 100 UNION ALL SELECT 'published', doc_id, published FROM a WHERE published <= 100""")
def library_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a hundred in three of the orders."""
    from pyspark.sql import Window as W

    r = _reports(spark, d)
    columns = {"words": F.col("n_chars"), "name": F.col("source"), "published": F.col("published")}
    out = None
    for by in columns:
        order = lb.list_order(by, columns, "doc_id")
        top = r.orderBy(*order).limit(100).select(F.lit(by).alias("by"), "doc_id", F.row_number().over(W.orderBy(*order)).alias("place"))
        out = top if out is None else out.union(top)
    return out


@query("""SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events""")
def previous_runs(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("open").alias("status"))
    return lb.previous_run(e, "user_id", "event_id", "status").select("event_id", "previous")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN true WHEN o_custkey % 4 = 1 THEN coalesce(d <= DATE '1997-06-30', true) AND coalesce(d + 30 >= DATE '1997-01-01', true) ELSE coalesce(d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30', false) END AS kept
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders)""")
def date_windows(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate"))
    kind = F.when(F.col("o_custkey") % 4 == 0, "group").when(F.col("o_custkey") % 4 == 1, "campaign").otherwise("report")
    return t(spark, d, "orders").select("o_orderkey", lb.kept_dates(day, kind, F.date_add(day, 30), "1997-01-01", "1997-06-30").alias("kept"))


@query("""SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, count(*) AS n, min(page_id) AS first, max(page_id) AS last FROM pages WHERE len(string_split(url, '/')) > 4 GROUP BY 1 ORDER BY n DESC, host LIMIT 100""")
def deep_domains(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), "page_id", (F.size(F.split("url", "/")) - 4).alias("depth"))
    return lb.depth_profile(p, "host", "depth", "page_id")


@query("""SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS total, count(DISTINCT l_partkey) AS covered, CAST(floor(100 * count(DISTINCT l_partkey) / (SELECT CAST(count(DISTINCT p_partkey) AS DOUBLE) FROM part) + 0.5) AS INT) AS share, count(DISTINCT l_orderkey) AS mapped_reports FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""")
def matrix_coverage(spark: SparkSession, d: str) -> DataFrame:
    links = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("technique"), F.col("l_orderkey").alias("report"))
    return lb.matrix_coverage(t(spark, d, "part").select(F.col("p_partkey").alias("technique")), links)


@query("""WITH e AS (SELECT l_partkey AS technique, CASE l_returnflag WHEN 'R' THEN 'observed' WHEN 'A' THEN 'inferred' ELSE 'mapped' END AS label, l_orderkey AS report, CAST(l_shipdate AS DATE) AS seen FROM lineitem)
SELECT technique, count(*) FILTER (WHERE label = 'observed') AS observed, count(*) FILTER (WHERE label = 'inferred') AS inferred, count(*) FILTER (WHERE label = 'mapped') AS mapped, count(DISTINCT report) AS reports,
arg_max(label, CASE label WHEN 'observed' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END) AS status, CAST(min(seen) AS VARCHAR) AS first_seen FROM e GROUP BY 1""")
def advisory_behaviours(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "R", "observed").when(F.col("l_returnflag") == "A", "inferred").otherwise("mapped").alias("label")
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("technique"), label, F.col("l_orderkey").alias("report"), F.to_date("l_shipdate").alias("seen"))
    return lb.behaviours(e).withColumn("first_seen", F.col("first_seen").cast("string"))


@query("""SELECT kind, rank, node, score, n FROM (SELECT c_custkey AS node, c_mktsegment AS kind, c_acctbal AS score, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE rank <= 6""")
def graph_insights(spark: SparkSession, d: str) -> DataFrame:
    return lb.insights(t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("score")))


@query("""SELECT CASE WHEN lang = 'es' THEN 'language' WHEN n_chars < 300 THEN 'stub' ELSE 'kept' END AS reason, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1""")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").withColumn("version", F.when(F.col("doc_id") % 3 == 0, 2).when(F.col("doc_id") % 3 == 1, 1))
    return lb.gate_pass(docs, F.when(F.col("lang") == "es", "language").when(F.col("n_chars") < 300, "stub"), "version", 2)[1]


@query("""WITH q AS (SELECT conv_id, lower(trim(regexp_replace(text, '\\\\s+', ' ', 'g'))) AS w, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations WHERE length(trim(text)) >= 25 GROUP BY 1, 2) SELECT conv_id, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, w) AS rank FROM q) WHERE rank <= 3""")
def defensive_quotes(spark: SparkSession, d: str) -> DataFrame:
    return lb.defensive_quotes(t(spark, d, "conversations"), "conv_id", "text", "turn", most=3)


@query("""WITH c AS (SELECT p_brand AS category, list(DISTINCT p_type ORDER BY p_type) AS qs FROM part GROUP BY 1), n AS (SELECT p_brand AS category, count(*) AS n FROM part WHERE p_size > 20 GROUP BY 1) SELECT category, qs[CAST(3 % len(qs) AS INT) + 1] AS query, 'thin' AS why FROM c LEFT JOIN n USING (category) ORDER BY coalesce(n, 0), category LIMIT 4""")
def thinnest_categories(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    q = lb.thinnest_queries(p.select(F.col("p_brand").alias("category"), F.col("p_type").alias("query")).distinct(), p.where("p_size > 20").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n")), 8, 3)
    return q.where("why = 'thin'")


@query("""SELECT p_partkey, lower(trim(p_name)) || ' ''x'' - y' AS name, 'T' || (1000 + p_partkey % 9000) AS id, p_name AS technique, CASE WHEN p_partkey % 2 = 0 THEN 'Execution' ELSE 'Impact' END AS tactic FROM part""")
def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    tactics = {"TA0002": ("Execution", ["execution"]), "TA0040": ("Impact", ["impact"])}
    said = lb.technique_of(F.concat(F.lit(" T"), F.col("p_partkey") % 9000 + 1000, F.lit(": "), "p_name"))
    tactic = lb.tactic_of(F.when(F.col("p_partkey") % 2 == 0, "see ta0002").otherwise("the Impact phase"), tactics)
    name = lb.normal_name(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ‘X’ — Y ")))
    return t(spark, d, "part").select("p_partkey", name.alias("name"), said["id"].alias("id"), said["name"].alias("technique"), tactic.alias("tactic"))


@query("""SELECT s_suppkey, CAST(DATE '2024-01-31' - to_months(CAST(greatest(1, least(s_suppkey, 36)) AS INT)) AS DATE)::VARCHAR AS since, least(5 + 2 * greatest(1, least(s_suppkey, 36)), 40) AS pages, least(50 * greatest(1, least(s_suppkey, 36)), 1000) AS links FROM supplier""")
def backfill_plans(spark: SparkSession, d: str) -> DataFrame:
    p = lb.backfill(F.col("s_suppkey").cast("int"), "2024-01-31")
    return t(spark, d, "supplier").select("s_suppkey", p["since"].cast("string").alias("since"), p["pages"].alias("pages"), p["links"].alias("links"))
