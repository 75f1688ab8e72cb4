"""Operators of profiles, rules, sets, state and sources over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import actors as ac
from siftwork.operators import facets as fc
from siftwork.operators import graph as gr
from siftwork.operators import quality as ql
from siftwork.operators import relational as rel
from siftwork.operators import rules as ru
from siftwork.operators import search as se
from siftwork.operators import state as st
from siftwork.plans.catalog import query
from siftwork.session import table as t
from siftwork.sources import feeds, structured

NOW = "2024-01-31 00:00:00"


@query("""SELECT doc_id FROM documents WHERE lower(lang) IN ('en', 'fr') AND lower(source) IN ('src0', 'src1')""")
def facet_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return fc.facet_filter(docs, {"lang": (F.array("lang"), ["EN", "fr"]), "source": (F.array("source"), ["src0", "SRC1"])}).select("doc_id")


@query("""SELECT page_id, regexp_matches(b, '^([^/?#]*[.])?example[.](org|net)([/?#]|$)') AND (regexp_matches(b, '^([^/?#]*[.])?example[.]org/en') OR regexp_matches(b, '^([^/?#]*[.])?example[.]net')) AS inside
FROM (SELECT page_id, regexp_replace(lower(url), '^https?://(www[.])?', '') AS b FROM pages)""")
def urls_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", ru.in_scope(F.col("url"), F.lit("https://*.Example.org/en*; example.net")).alias("inside"))


@query("""SELECT event_id, event_type IS NULL OR event_type <> 'view' AS stale FROM events""")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", 3).when(F.col("event_type") == "error", F.lit(None)).otherwise(2)
    return t(spark, d, "events").select("event_id", st.stale(kind, 3).alias("stale"))


@query("""SELECT event_id, CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) - CAST(floor(value) AS BIGINT) * 60 > 600 THEN 'no_heartbeat'
WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) > 6 * 3600 THEN 'too_long' END AS why FROM events""")
def hung_jobs(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("second", "ts")
    beat = F.timestamp_seconds(F.unix_timestamp(start) + F.floor("value").cast("bigint") * 60)
    return t(spark, d, "events").select("event_id", ru.hung(start, beat, NOW).alias("why"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN true WHEN event_id % 7 = 0 THEN true ELSE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 14 END AS again FROM events""")
def revalidation(spark: SparkSession, d: str) -> DataFrame:
    fetched = F.when(F.col("event_type") != "error", F.col("ts"))
    hinted = F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts"))
    return t(spark, d, "events").select("event_id", st.needs_revalidation(fetched, hinted, NOW, 14).alias("again"))


@query("""SELECT page_id, '***' AS secret, url AS shown FROM pages""")
def redacted_config(spark: SparkSession, d: str) -> DataFrame:
    conf = ru.redact_config(F.create_map(F.lit("API_Key"), F.col("url"), F.lit("start"), F.col("url")))
    return t(spark, d, "pages").select("page_id", conf["API_Key"].alias("secret"), conf["start"].alias("shown"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'official' WHEN lang = 'de' THEN 'structured' WHEN n_chars % 3 = 0 THEN 'primary' WHEN n_chars % 5 = 0 THEN 'syndicated' ELSE 'secondary' END AS class, n_chars % 101 AS q FROM documents)
SELECT doc_id, class, CASE class WHEN 'official' THEN 1 WHEN 'structured' THEN 2 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 ELSE 4 END AS tier,
round(CASE class WHEN 'official' THEN 1.0 WHEN 'structured' THEN 0.9 WHEN 'primary' THEN 0.9 WHEN 'secondary' THEN 0.75 ELSE 0.6 END * CASE WHEN q > 1 THEN q / 100.0 ELSE CAST(q AS DOUBLE) END, 3) AS confidence FROM p""")
def provenance_classes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("lang") == "de", F.array(F.lit("STRUCTURED"))).otherwise(F.array().cast("array<string>"))
    p = ql.provenance(kinds, F.col("n_chars") % 5 == 0, F.col("source") == "src0", F.col("n_chars") % 3 == 0, (F.col("n_chars") % 101).cast("double"))
    return t(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.class", "p.tier", F.col("p.confidence"))


@query("""SELECT a.l_orderkey * 10 + a.l_linenumber AS step, CASE WHEN b.r > a.r THEN 'improved' ELSE 'regressed' END AS change
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 4 AS r FROM lineitem) a JOIN (SELECT l_orderkey, l_linenumber, CAST(round(l_tax * 100) AS INT) % 4 AS r FROM lineitem) b USING (l_orderkey, l_linenumber) WHERE a.r <> b.r""")
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("step"), (F.col("l_quantity").cast("int") % 4).alias("x"), (F.round(F.col("l_tax") * 100).cast("int") % 4).alias("y"))
    return rel.compare_runs(rows.withColumnRenamed("x", "rank"), rows.withColumnRenamed("y", "rank"), "step", F.col("rank"))


_ACTORS = """one AS (SELECT l_suppkey AS actor, l_orderkey AS report, min(CAST(l_shipdate AS DATE)) AS seen FROM lineitem GROUP BY 1, 2),
t AS (SELECT actor, count(DISTINCT l_partkey % 50) AS n FROM one JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x ON report = l_orderkey GROUP BY 1),
i AS (SELECT actor, count(*) AS reports, min(seen) AS first_seen, max(seen) AS last_seen FROM one GROUP BY 1)"""


@query(f"""WITH {_ACTORS} SELECT i.actor, i.reports, CAST(i.first_seen AS VARCHAR) AS first_seen, CAST(i.last_seen AS VARCHAR) AS last_seen, t.n AS n_techniques FROM i JOIN t USING (actor)""")
def actor_profiles(spark: SparkSession, d: str) -> DataFrame:
    out = _actor_index(spark, d)
    return out.select("actor", "reports", F.col("first_seen").cast("string"), F.col("last_seen").cast("string"), "n_techniques")


def _actor_index(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    links = li.select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("report"), F.to_date("l_shipdate").alias("seen"))
    techniques = li.select(F.col("l_orderkey").alias("report"), (F.col("l_partkey") % 50).alias("technique")).distinct()
    return ac.actor_index(links, techniques, "1998-12-31")


@query(f"""WITH {_ACTORS} SELECT count(*) AS observed, count(*) FILTER (WHERE actor % 3 <> 0) AS not_known, CAST(max(last_seen) AS VARCHAR) AS last_seen FROM i""")
def actor_kpis(spark: SparkSession, d: str) -> DataFrame:
    known = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"))
    return ac.kpis(_actor_index(spark, d), known).select("observed", "not_known", F.col("last_seen").cast("string"))


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS actor, l_partkey AS technique FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_suppkey AS actor, l_partkey AS technique FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT coalesce(o.actor, a.actor) AS actor, coalesce(o.technique, a.technique) AS technique, a.actor IS NOT NULL AS a, o.actor IS NOT NULL AS o FROM o FULL JOIN a ON o.actor = a.actor AND o.technique = a.technique)
SELECT actor, p_brand AS tactic, count(*) FILTER (WHERE a) AS attributed, count(*) FILTER (WHERE o) AS observed FROM b JOIN part ON technique = p_partkey GROUP BY 1, 2""")
def tactic_coverage(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("actor"), F.col("l_partkey").alias("technique"), "l_returnflag")
    tactics = t(spark, d, "part").select(F.col("p_partkey").alias("technique"), F.col("p_brand").alias("tactic"))
    return ac.tactic_coverage(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), tactics)


@query("""WITH h AS (SELECT l_partkey AS cve, l_orderkey * 10 + l_linenumber AS report, l_quantity AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem)
SELECT CAST(cve AS VARCHAR) AS cve, sum(CASE WHEN r <= 5 THEN score * 0.5 ELSE 0 END) + CASE WHEN cve IN (3, 7) THEN 20 ELSE 0 END AS score, count(*) AS reports FROM h GROUP BY cve""")
def vulnerability_rollup(spark: SparkSession, d: str) -> DataFrame:
    hits = t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("cve"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("report"), F.col("l_quantity").alias("score"))
    return ru.vulnerability_rollup(hits, ["3", "7"], 5)


@query("""WITH s AS (SELECT event_id AS step, event_id % 4 AS o, user_id % 3 AS p, event_id % 2 AS k, (event_id // 5) % 4 AS b FROM events), x AS (SELECT *, CASE WHEN o = 0 THEN 2 ELSE 1 END + p + k AS points FROM s WHERE o IN (0, 1))
SELECT step, points, CASE WHEN points >= 6 THEN 'critical' WHEN points >= 4 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN b > o THEN 'regressed' WHEN b < o THEN 'improved' ELSE 'open' END AS trend FROM x""")
def findings_severity(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("missed", "logged", "detected", "prevented")])
    outcome = lambda c: F.element_at(names, (c % 4 + 1).cast("int"))
    s = t(spark, d, "events").select(F.col("event_id").alias("step"), outcome(F.col("event_id")).alias("outcome"), (F.col("user_id") % 3).alias("priority"), (F.col("event_id") % 2).alias("risk"), outcome(F.floor(F.col("event_id") / 5)).alias("was"))
    return ru.findings(s.drop("was"), s.select("step", F.col("was").alias("outcome")), "step")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR (o_orderstatus = 'F' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 90 AND o_totalprice > 200000) THEN 'critical'
WHEN o_orderpriority = '2-HIGH' OR o_orderstatus = 'F' OR (o_custkey % 10 >= 5 AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 180) THEN 'high' WHEN o_custkey % 10 > 0 THEN 'medium' ELSE 'low' END AS severity FROM orders""")
def severities(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    confidence = F.when(F.col("o_totalprice") > 200000, 0.9).otherwise(0.5)
    s = ql.severity(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH", F.col("o_orderstatus") == "F", F.col("o_custkey") % 10, confidence, age, F.col("o_custkey") % 10)
    return t(spark, d, "orders").select("o_orderkey", s.alias("severity"))


@query("""WITH s AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'a' WHEN l_linestatus = 'O' THEN 'b' ELSE 'c' END AS type, l_linenumber AS w, CAST(l_partkey AS VARCHAR) AS reason FROM lineitem),
v AS (SELECT k, type, CAST(sum(w) AS DOUBLE) AS score, arg_max(reason, (w, reason)) AS reason FROM s GROUP BY 1, 2), r AS (SELECT *, greatest(2.4, 0.35 * max(score) OVER (PARTITION BY k)) AS b, row_number() OVER (PARTITION BY k ORDER BY score DESC, type) AS n FROM v)
SELECT k, type, score, reason FROM r WHERE score >= b AND n <= 2""")
def document_type_votes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "a").when(F.col("l_linestatus") == "O", "b").otherwise("c")
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), kind.alias("type"), F.col("l_linenumber").cast("double").alias("weight"), F.col("l_partkey").cast("string").alias("reason"))
    return ql.type_votes(s, "k", most=2)


@query("""WITH n AS (SELECT p_name AS name, max(p_size) > 25 AS seen FROM part GROUP BY 1), r AS (SELECT name, seen, CASE WHEN lower(name) = 'cold' THEN 0.0 WHEN starts_with(lower(name), 'cold') THEN 1.0 WHEN contains(lower(name), 'cold') THEN 2.0 END - CASE WHEN seen THEN 0.5 ELSE 0 END AS rank FROM n)
SELECT name, seen, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, name LIMIT 8""")
def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg((F.max("p_size") > 25).alias("seen"))
    return ac.suggest(names, "Cold")


@query("""WITH e AS (SELECT l_suppkey AS node, count(DISTINCT l_orderkey) AS reports, count(DISTINCT l_partkey) AS degree, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1)
SELECT node, round(2 * log2(1 + reports) + log2(1 + degree) + 1 / (1 + greatest(date_diff('day', last, DATE '1998-12-31'), 0) / 180.0), 6) AS importance FROM e""")
def node_importance(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.countDistinct("l_orderkey").alias("reports"), F.countDistinct("l_partkey").alias("degree"), F.max(F.to_date("l_shipdate")).alias("last"))
    return e.select("node", F.round(gr.importance(F.col("reports"), F.col("degree"), F.col("last"), "1998-12-31"), 6).alias("importance"))


@query("""SELECT l_suppkey AS node, floor(sum(10 * pow(0.5, greatest(date_diff('day', seen, DATE '1998-12-31'), 0) / 180.0)) * 100 + 0.5) / 100 AS score FROM (SELECT l_suppkey, l_orderkey, min(CAST(l_shipdate AS DATE)) AS seen FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def decayed_scores(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("report")).agg(F.min(F.to_date("l_shipdate")).alias("seen"))
    return gr.decayed_activity(li, "1998-12-31")


@query("""WITH v AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN ' none ' ELSE ' ' || l_returnflag || l_linestatus || ' ' END AS x FROM lineitem),
c AS (SELECT l_orderkey, list(DISTINCT lower(trim(x))) FILTER (WHERE lower(trim(x)) <> 'none') AS l FROM v GROUP BY 1) SELECT l_orderkey, coalesce(list_sort(l), []) AS names FROM c""")
def distinct_spellings(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("l_returnflag") == "N", " none ").otherwise(F.concat(F.lit(" "), "l_returnflag", "l_linestatus", F.lit(" ")))
    low = F.when(F.col("l_linenumber") % 2 == 0, F.lower(x)).otherwise(x)
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(low).alias("x"))
    return rows.select("l_orderkey", F.array_sort(F.transform(rel.distinct_spellings(F.col("x")), F.lower)).alias("names"))


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT 'T' || (l_partkey % 9) || CASE WHEN l_linenumber % 2 = 0 THEN '.1' ELSE '' END)) AS ids, list(DISTINCT 'T' || (l_suppkey % 9)) AS known FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_filter(ids, lambda x: NOT list_contains(known, split_part(x, '.', 1))) AS new FROM g""")
def new_against_known(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.concat(F.lit("T"), F.col("l_partkey") % 9, F.when(F.col("l_linenumber") % 2 == 0, ".1").otherwise(""))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(id_)).alias("ids"), F.collect_set(F.concat(F.lit("T"), F.col("l_suppkey") % 9)).alias("known"))
    return g.select("l_orderkey", rel.parent_aware_difference(F.col("ids"), F.col("known")).alias("new"))


@query("""SELECT doc_id, CASE WHEN h IN ('rules', 'analyst') THEN 'unchanged' WHEN h = 'ai' AND n_chars % 2 = 0 THEN 'restore' WHEN quality = 1 THEN 'keep' WHEN toxic = 0 THEN 'flag' WHEN lang = 'en' OR n_chars % 10 < 5 THEN 'flag' ELSE 'hide' END AS action
FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'rules' WHEN doc_id % 5 = 1 THEN 'ai' ELSE '' END AS h FROM documents JOIN labels USING (doc_id))""")
def review_actions(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    by = F.when(F.col("doc_id") % 5 == 0, "rules").when(F.col("doc_id") % 5 == 1, "ai").otherwise("")
    verdict = F.when(F.col("quality") == 1, "useful").when(F.col("toxic") == 0, "unsure").otherwise("noise")
    confidence = F.when(F.col("n_chars") % 10 < 5, 0.5).otherwise(0.9)
    return j.select("doc_id", ql.review_action(verdict, F.col("lang") == "en", confidence, by, F.lit(True), F.col("n_chars") % 2 == 0).alias("action"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'reports' WHEN 'de' THEN 'advisories' ELSE 'unclassified_documents' END AS route FROM documents""")
def routed(spark: SparkSession, d: str) -> DataFrame:
    return structured.route(t(spark, d, "documents"), {"en": "reports", "de": "advisories"}, "lang").select("doc_id", "route")


@query("""SELECT event_id, CAST(u - INTERVAL 60 DAY AS DATE)::VARCHAR AS since, CAST(u AS DATE)::VARCHAR AS until FROM (SELECT event_id, CASE WHEN event_type = 'error' OR c <= DATE '2021-01-31' THEN DATE '2024-01-31' ELSE c END AS u FROM (SELECT event_id, event_type, CAST(ts AS DATE) - CAST(user_id * 10 AS INT) AS c FROM events))""")
def archive_windows(spark: SparkSession, d: str) -> DataFrame:
    cursor = F.when(F.col("event_type") != "error", F.date_sub(F.to_date("ts"), (F.col("user_id") * 10).cast("int")))
    w = ru.next_window(cursor, "2024-01-31")
    return t(spark, d, "events").select("event_id", w["since"].cast("string").alias("since"), w["until"].cast("string").alias("until"))


@query("""SELECT l_orderkey, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS jaccard FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 7) AS a, list(DISTINCT l_suppkey % 7) AS b FROM lineitem GROUP BY 1)""")
def jaccard_sets(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 7).alias("a"), F.collect_set(F.col("l_suppkey") % 7).alias("b"))
    return g.select("l_orderkey", tx.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query("""WITH o AS (SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM o WHERE r <= 2""")
def passages_per_document(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem")
    return rel.top_per_group(rows, ["l_partkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], 2).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, p.p AS parent FROM (SELECT l_orderkey, l_linenumber, 'T' || (l_partkey % 40) || CASE WHEN l_linenumber % 2 = 0 THEN '.00' || l_linenumber ELSE '' END AS id FROM lineitem) x JOIN (SELECT DISTINCT 'T' || (p_size % 20) AS p FROM part) p ON x.id = p.p OR starts_with(x.id, p.p || '.')""")
def techniques_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.concat(F.lit("T"), F.col("l_partkey") % 40, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(".00"), "l_linenumber")).otherwise(""))
    right = t(spark, d, "part").select(F.concat(F.lit("T"), F.col("p_size") % 20).alias("parent")).distinct()
    return rel.by_prefix(t(spark, d, "lineitem").withColumn("id", id_), "id", right, "parent").select("l_orderkey", "l_linenumber", "parent")


@query("""WITH k AS (SELECT DISTINCT 'CVE-2024-' || (1000 + p_partkey) AS id, p_size > 25 AS ransomware FROM part WHERE p_partkey % 3 = 0), v AS (SELECT l_orderkey, l_linenumber, 'cve-2024-' || (1000 + l_partkey) AS cve FROM lineitem)
SELECT l_orderkey, l_linenumber, cve, k.id IS NOT NULL AS listed, coalesce(k.ransomware, false) AS ransomware FROM v LEFT JOIN k ON upper(v.cve) = k.id""")
def known_exploited(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    kev = t(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("CVE-2024-"), F.col("p_partkey") + 1000).alias("cveID"), none.alias("dateAdded"), none.alias("dueDate"), none.alias("requiredAction"), (F.col("p_size") > 25).alias("ransomware"))
    v = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("cve-2024-"), F.col("l_partkey") + 1000).alias("cve"))
    return structured.kev_matches(v, kev).select("l_orderkey", "l_linenumber", "cve", "listed", F.coalesce("ransomware", F.lit(False)).alias("ransomware"))


@query("""WITH o AS (SELECT 'T' || (p_partkey % 30) || CASE WHEN p_partkey % 2 = 0 THEN '.001' ELSE '' END AS technique_id, p_type AS kind, p_name || ' ' || p_partkey AS name FROM part), w AS (SELECT DISTINCT 'T' || (s_suppkey % 12) AS wanted FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY kind, name) AS r FROM o JOIN w ON technique_id = wanted OR starts_with(technique_id, wanted || '.')) SELECT wanted, technique_id, kind, name FROM r WHERE r <= 3""")
def emulation_options(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.concat(F.lit("T"), F.col("p_partkey") % 30, F.when(F.col("p_partkey") % 2 == 0, ".001").otherwise(""))
    options = t(spark, d, "part").select(id_.alias("technique_id"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    wanted = t(spark, d, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey") % 12).alias("technique_id"))
    return structured.options_by_technique(options, wanted, most=3).select("wanted", "technique_id", "kind", "name")


@query("""SELECT o_custkey AS k, CASE WHEN b.n IS NULL THEN s.v ELSE b.v END AS v, b.n IS NOT NULL AS fresh FROM (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) s LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 GROUP BY 1) b USING (o_custkey) WHERE b.n IS NOT NULL OR o_custkey % 3 <> 0
UNION ALL SELECT o_custkey, min(o_orderkey), true FROM orders o WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus <> 'O') GROUP BY 1""")
def upsert_with_prune(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    stored = o.where("o_orderstatus <> 'O'").groupBy("k").agg(F.max("o_orderkey").alias("v")).withColumn("fresh", F.lit(False))
    batch = o.where("o_orderstatus = 'O' and k % 2 = 0").groupBy("k").agg(F.min("o_orderkey").alias("v")).withColumn("fresh", F.lit(True))
    return st.upsert_and_prune(stored, batch, ["k"], prune=True, scope=F.col("k") % 3 == 0)


@query("""SELECT source, count(*) + count(*) FILTER (WHERE lang = 'en') AS n FROM documents GROUP BY 1""")
def discovered_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    count = lambda x: x.groupBy("source").agg(F.count("*").alias("n"))
    return st.add_counts(count(docs), count(docs.where("lang = 'en'")), "source", "n")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'ready' ELSE 'acquired' END ELSE 'new' END AS status,
CASE WHEN toxic = 1 AND doc_id % 4 <> 0 THEN 'new' WHEN toxic = 1 AND doc_id % 8 = 0 THEN 'ready' END AS previous_status FROM labels""")
def hidden_and_restored(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "labels").select("doc_id", "toxic", F.when(F.col("doc_id") % 4 == 0, "rejected").otherwise("new").alias("status"), F.when(F.col("doc_id") % 8 == 0, "ready").alias("previous_status"))
    return st.hide(rows, F.col("toxic") == 1).select("doc_id", "status", "previous_status")


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://((amp|m|mobile)[.])?', ''), '[/?#].*$', ''), '^www[.]', '') AS host FROM pages WHERE regexp_matches(url, '[?&]utm_source=') AND NOT regexp_matches(url, '#')""")
def tracked_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address had tracking, by the host of their canonical address."""
    from siftwork.operators.extract import canonical_urls

    pages = canonical_urls(t(spark, d, "pages").select("page_id", "url"), "url")
    gone = F.col("url").rlike("[?&]utm_source=") & ~F.col("url").contains("#") & ~F.col("canonical_url").contains("utm_source")
    return pages.where(gone).select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("canonical_url"), "^https?://", ""), "[/?#].*$", ""), "^www[.]", "").alias("host"))


@query("""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(x, 'CVE-[0-9]{4}-[0-9]{4,7}'), lambda v: lower(v)))) AS ids FROM (SELECT doc_id, 'see CVE-2024-' || (1000 + doc_id % 9000) || ' and CVE-2021-44228, not CVE-1-2; ' || text AS x FROM documents)""")
def protected_ids(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("see CVE-2024-"), F.col("doc_id") % 9000 + 1000, F.lit(" and CVE-2021-44228, not CVE-1-2; "), "text")
    return t(spark, d, "documents").select("doc_id", F.array_sort(F.filter(ru.protected_tokens(x), lambda v: v.startswith("cve-"))).alias("ids"))


@query("""SELECT conv_id, turn, list_filter(n, lambda x: x BETWEEN 1 AND 3) AS known, list_filter(n, lambda x: NOT x BETWEEN 1 AND 3) AS unknown FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN [1, 2] WHEN turn % 4 IN (2, 3) THEN [1, CAST(turn % 4 AS INT) + 2] ELSE [1, 2] END AS n FROM conversations)""")
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat("text", F.lit(" as said [S1]; more [S1, S"), F.when(F.col("turn") % 4 > 1, F.col("turn") % 4 + 2).otherwise(2), F.lit("]"))
    c = ru.citations(answer, F.lit(3))
    return t(spark, d, "conversations").select("conv_id", "turn", c["known"].alias("known"), c["unknown"].alias("unknown"))


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT host, path, NOT starts_with(path, '/es/') OR starts_with(path, '/es/1') AS allowed FROM h""")
def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    urls = t(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
    files = urls.select("host").distinct().withColumn("text", F.lit("User-agent: *\nDisallow: /es/\nAllow: /es/1\n"))
    return feeds.robots_allowed(urls, feeds.read_robots(files, "host", "text"), "host", "path").select("host", "path", "allowed")


@query("""SELECT doc_id, n_chars // 1000 AS page FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50""")
def third_page(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    return se.page(docs, [F.desc("n_chars"), F.col("doc_id")], 25, 50).select("doc_id", F.floor(F.col("n_chars") / 1000).alias("page"))


@query("""SELECT l_orderkey, least(6 * count(DISTINCT l_partkey % 9), 30) + least(2 * count(*), 25) + least(4 * count(*) FILTER (WHERE l_returnflag = 'R'), 20) + least(3 * count(DISTINCT l_suppkey % 5), 10) + least(3 * count(*) FILTER (WHERE l_linestatus = 'O'), 25) + least(5 * count(*) FILTER (WHERE l_tax > 0.05), 15) + CASE WHEN max(l_quantity) > 45 THEN 15 ELSE 0 END AS depth FROM lineitem GROUP BY 1""")
def technical_depths(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.countDistinct(F.col("l_partkey") % 9).alias("t"), F.count("*").alias("i"), F.count_if(F.col("l_returnflag") == "R").alias("c"), F.countDistinct(F.col("l_suppkey") % 5).alias("a"),
        F.count_if(F.col("l_linestatus") == "O").alias("b"), F.count_if(F.col("l_tax") > 0.05).alias("e"), (F.max("l_quantity") > 45).alias("x"),
    )
    return g.select("l_orderkey", ru.technical_depth(*[F.col(c) for c in "ticabex"]).alias("depth"))


@query("""SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 800) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 800) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 800) AS fn,
count(*) FILTER (WHERE quality = 1 AND n_chars > 800) / CAST(count(*) FILTER (WHERE n_chars > 800) AS DOUBLE) AS precision, count(*) FILTER (WHERE quality = 1 AND n_chars > 800) / CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS recall FROM documents JOIN labels USING (doc_id)""")
def gate_evaluation(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return ql.evaluation(j, F.col("n_chars") > 800, F.col("quality") == 1)


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN NULL WHEN source = 'src0' AND NOT (n_chars % 3 >= 1) THEN 'page_type' WHEN n_chars % 7 = 0 AND NOT (n_chars % 3 >= 1) THEN 'content' WHEN n_chars % 120 BETWEEN 1 AND 119 AND n_chars % 2 = 0 THEN 'stub' END AS reason FROM documents""")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    n, no, zero = F.col("n_chars"), F.lit(False), F.lit(0)
    r = ql.library_gate(F.col("lang") == "en", no, (n % 3).cast("int"), (n % 2).cast("int"), zero, F.lit(0.1), (n % 120).cast("int"), F.col("source") == "src0", n % 7 == 0, no, no)
    return t(spark, d, "documents").select("doc_id", r.alias("reason"))


@query("""SELECT doc_id, list_filter(['no observed behaviour', 'no indicators', 'no detections', 'sources older than a year'], lambda x, i: (i = 1 AND n_chars % 2 = 0) OR (i = 2 AND n_chars % 3 = 0) OR (i = 3 AND n_chars % 5 = 0) OR (i = 4 AND n_chars > 365)) AS gaps FROM documents""")
def advisory_gaps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return t(spark, d, "documents").select("doc_id", ru.gaps(n % 2, n % 3, n % 5, n).alias("gaps"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'G' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'S' || s_suppkey ELSE 'name:supplier-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS id FROM supplier""")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Group before software for one alias; unknown names get a slug."""
    s = t(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "#", " ").alias("name"))
    groups = s.where("s_suppkey % 3 = 0").select(F.upper("name").alias("alias"), F.concat(F.lit("G"), "s_suppkey").alias("id"), F.lit("group").alias("kind"))
    tools = s.where("s_suppkey % 3 < 2").select(F.col("name").alias("alias"), F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("software").alias("kind"))
    return ac.resolve_names(s.withColumn("name", F.concat("name", F.lit(" Group"))), groups.union(tools)).select("s_suppkey", "id")
