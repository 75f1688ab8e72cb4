"""Scans, joins, aggregates, facets, sets and top-k over the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.operators import facets as fc
from siftwork.operators import relational as rel
from siftwork.plans.catalog import query
from siftwork.session import table as t


@query("""SELECT source AS value, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12""")
def facet_source(spark: SparkSession, d: str) -> DataFrame:
    return fc.facet(t(spark, d, "documents"), F.array("source"))


@query("""SELECT CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY value DESC LIMIT 20""")
def facet_year(spark: SparkSession, d: str) -> DataFrame:
    return fc.facet(t(spark, d, "orders"), F.array(F.year("o_orderdate").cast("string")), 20, descending_value=True)


@query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> '' GROUP BY source
UNION ALL SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END, count(*) FROM documents GROUP BY 2""")
def facet_set_documents(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return fc.facet_set(t(spark, d, "documents"), {"lang": F.array("lang"), "source": F.array("source"), "size": F.array(size)})


@query("""SELECT count(*) FILTER (WHERE a BETWEEN 0 AND 7) AS last_7d, count(*) FILTER (WHERE a BETWEEN 0 AND 30) AS last_30d,
count(*) FILTER (WHERE a BETWEEN 0 AND 90) AS last_90d, count(*) FILTER (WHERE a IS NULL) AS undated, count(*) AS any_time
FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS a FROM events)""")
def window_counts_7_30_90(spark: SparkSession, d: str) -> DataFrame:
    return fc.recency_counts(t(spark, d, "events"), F.col("ts"), "2024-01-31", [7, 30, 90])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_good, round(avg(quality), 2) AS avg_quality, sum(toxic) AS n_toxic FROM labels""")
def kpi_labels(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.round(F.avg("quality"), 2).alias("avg_quality"), F.sum("toxic").alias("n_toxic"))


@query("""SELECT source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, round(avg(n_chars), 3) AS avg_chars FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 100""")
def domain_profile(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.round(F.avg("n_chars"), 3).alias("avg_chars"))
    return g.orderBy(F.desc("n"), "source").limit(100)


@query("""SELECT user_id, count(*) AS found, count(*) FILTER (WHERE event_type = 'purchase') AS ingested, count(*) FILTER (WHERE event_type = 'error') AS failed
FROM events GROUP BY 1 ORDER BY ingested DESC, found DESC, user_id LIMIT 8""")
def conditional_counts_top8(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    g = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(e == "purchase").alias("ingested"), F.count_if(e == "error").alias("failed"))
    return g.orderBy(F.desc("ingested"), F.desc("found"), "user_id").limit(8)


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def join_orders_customers(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("""SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY 1 ORDER BY orders DESC, c_custkey LIMIT 8""")
def left_join_top8(spark: SparkSession, d: str) -> DataFrame:
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    g = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    return g.orderBy(F.desc("orders"), "c_custkey").limit(8)


@query("""WITH a AS (SELECT doc_id AS k, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1), b AS (SELECT doc_id % 1000 AS k, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1)
SELECT d.doc_id, coalesce(nullif(a.n, 0), nullif(b.n, 0), 0) AS n FROM documents d LEFT JOIN a ON d.doc_id = a.k LEFT JOIN b ON d.n_chars % 1000 = b.k""")
def fallback_join_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    a = t(spark, d, "labels").where("quality = 1").groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("n"))
    b = docs.where("lang = 'de'").groupBy((F.col("doc_id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    return rel.fallback_counts(docs, [(F.col("doc_id"), a, "k"), (F.col("n_chars") % 1000, b, "k")]).select("doc_id", "n")


@query("""SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""")
def anti_join_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def semi_join_toxic(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").join(t(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 10""")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "documents").where("lang = 'en' and n_chars >= 500").select("doc_id", "source", "n_chars")
    return df.orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(50)


@query("""SELECT * FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3""")
def top3_per_source(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t(spark, d, "documents").select("doc_id", "source", "n_chars", F.row_number().over(w).alias("r")).where("r <= 3")


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, source, n_chars, CASE WHEN k = 1 THEN 0 ELSE 1 END AS pass FROM r ORDER BY pass, n_chars DESC, doc_id LIMIT 30""")
def leaders_then_fill(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return rel.leaders_then_fill(df, "source", "n_chars", "doc_id", 30)


@query("""WITH u AS (SELECT doc_id, 'toxic' AS via, 0 AS p FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'long', 1 FROM documents WHERE n_chars > 3000
UNION ALL SELECT doc_id, 'french', 2 FROM documents WHERE lang = 'fr') SELECT doc_id, arg_min(via, p) AS via FROM u GROUP BY 1""")
def ordered_union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    a = t(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("via"))
    return rel.first_wins_union([a, docs.where("n_chars > 3000").select("doc_id", F.lit("long").alias("via")), docs.where("lang = 'fr'").select("doc_id", F.lit("french").alias("via"))], "doc_id")


@query("""SELECT conv_id, count(*) AS turns, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text,
coalesce(array_to_string(list(text ORDER BY turn) FILTER (WHERE role = 'user'), '|'), '') AS user_texts FROM conversations GROUP BY 1""")
def conversation_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = rel.conversation_rollup(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.withColumn("user_texts", F.array_join("user_texts", "|"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT u.label, count(DISTINCT d.doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('ja')) u(label) LEFT JOIN documents d ON d.lang = u.label GROUP BY 1""")
def coverage_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return fc.coverage(t(spark, d, "documents"), F.array("lang"), ["en", "fr", "de", "es", "ja"])


@query("""WITH r AS (SELECT user_id % 10 AS run, CASE event_type WHEN 'purchase' THEN 'prevented' WHEN 'click' THEN 'detected' WHEN 'view' THEN 'logged' WHEN 'error' THEN 'missed' ELSE 'not_run' END AS o FROM events),
s AS (SELECT run, count(*) FILTER (WHERE o = 'prevented') AS prevented, count(*) FILTER (WHERE o = 'detected') AS detected, count(*) FILTER (WHERE o = 'logged') AS logged,
count(*) FILTER (WHERE o = 'missed') AS missed, count(*) FILTER (WHERE o = 'not_run') AS not_run, count(*) AS steps FROM r GROUP BY 1)
SELECT *, prevented + detected + logged + missed AS executed, prevented / nullif(prevented + detected + logged + missed, 0) AS prevention_rate,
(prevented + detected) / nullif(prevented + detected + logged + missed, 0) AS detection_rate, (prevented + detected + logged) / nullif(prevented + detected + logged + missed, 0) AS visibility_rate FROM s""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = {"purchase": "prevented", "click": "detected", "view": "logged", "error": "missed"}
    o = F.lit("not_run")
    for k, v in names.items():
        o = F.when(F.col("event_type") == k, v).otherwise(o)
    return rel.run_metrics(t(spark, d, "events").select((F.col("user_id") % 10).alias("run"), o.alias("o")), "run", "o")


@query("""WITH s AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 50 <> 7), q AS (SELECT doc_id, CASE WHEN doc_id % 40 = 3 THEN sha256(text || 'x') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 60 <> 9)
SELECT coalesce(s.doc_id, q.doc_id) AS doc_id, CASE WHEN q.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'surplus' ELSE 'changed' END AS problem
FROM s FULL JOIN q ON s.doc_id = q.doc_id WHERE q.doc_id IS NULL OR s.doc_id IS NULL OR s.sha <> q.sha""")
def migration_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    s = docs.where("doc_id % 50 <> 7").select("doc_id", F.sha2("text", 256).alias("sha"))
    changed = F.when(F.col("doc_id") % 40 == 3, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return rel.verify(s, docs.where("doc_id % 60 <> 9").select("doc_id", changed.alias("sha")), "doc_id", "sha")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE n_chars > 10000) AS n_long, count(*) FILTER (WHERE contains(text, '@')) AS n_mail, count(DISTINCT source) AS n_sources, max(doc_id) AS last_id FROM documents""")
def storage_stats(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("n_chars") > 10000).alias("n_long"),
        F.count_if(F.col("text").contains("@")).alias("n_mail"), F.countDistinct("source").alias("n_sources"), F.max("doc_id").alias("last_id"),
    )


@query("""SELECT p_brand, p_type, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE starts_with(p_type, 'PROMO') OR p_size <= 5 GROUP BY 1, 2""")
def join_filter_parts(spark: SparkSession, d: str) -> DataFrame:
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    j = li.join(p, li.l_partkey == p.p_partkey).where(F.col("p_type").startswith("PROMO") | (F.col("p_size") <= 5))
    return j.groupBy("p_brand", "p_type").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
