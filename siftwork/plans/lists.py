"""The library's list, audit and test plans over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.operators import audit as au
from siftwork.operators import listing as ls
from siftwork.operators import prioritise as pr
from siftwork.plans.catalog import query
from siftwork.session import table as t

_ORDERS = "o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_custkey"


@query(f"""WITH o AS (SELECT {_ORDERS} FROM orders) SELECT o_orderkey FROM o WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') AND o_orderstatus IN ('F', 'O') AND day >= DATE '1995-01-01' AND day <= DATE '1997-06-30' AND o_totalprice >= 50000 AND o_custkey % 3 = 0""")
def library_choice(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reports: two facets, a window, a least quality and a flag."""
    o = t(spark, d, "orders")
    c = ls.Choice({"priority": ["1-URGENT", "2-high"], "status": ["f", "o"], "clerk": []}, "1995-01-01", "1997-06-30", 50000.0, ["thirds"])
    ok = ls.chosen(c, {"priority": F.array("o_orderpriority"), "status": F.array("o_orderstatus"), "clerk": F.array("o_clerk") if "o_clerk" in o.columns else F.array(F.lit(""))}, F.col("o_orderdate"), F.col("o_totalprice").cast("double"), {"thirds": F.col("o_custkey") % 3 == 0})
    return o.where(ok).select("o_orderkey")


_COLS = """CASE WHEN doc_id % 4 = 0 THEN doc_id % 10 END AS rank, CASE WHEN doc_id % 5 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 200 AS INT) END AS published, DATE '2024-06-01' + CAST(doc_id % 37 AS INT) AS ingested, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS grade, doc_id % 7 AS simulation, n_chars % 11 AS quality, CASE WHEN doc_id % 6 > 0 THEN n_chars % 5 END AS n_iocs, n_chars % 9 AS n_techniques, n_chars AS words"""
_BY = {
    "relevance": "rank NULLS LAST, ingested DESC", "published": "published DESC NULLS LAST, ingested DESC", "emulation": "coalesce(grade, 0) DESC, simulation DESC, published DESC NULLS LAST", "quality": "quality DESC",
    "iocs": "coalesce(n_iocs, 0) DESC", "techniques": "n_techniques DESC", "words": "words DESC", "newest": "ingested DESC",
}


@query(f"WITH r AS (SELECT doc_id, {_COLS} FROM documents) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS by, row_number() OVER (ORDER BY {o}, doc_id) AS place, doc_id FROM r) WHERE place <= 100" for k, o in _BY.items()))
def library_orders_all(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a hundred in each of the eight orders."""
    i, n = F.col("doc_id"), F.col("n_chars")
    day = lambda start, k: F.date_add(F.lit(start).cast("date"), (i % k).cast("int"))
    c = {
        "rank": F.when(i % 4 == 0, i % 10), "published": F.when(i % 5 > 0, day("2024-01-01", 200)), "ingested": day("2024-06-01", 37), "grade": F.when(i % 3 > 0, i % 3), "simulation": i % 7,
        "quality": n % 11, "n_iocs": F.when(i % 6 > 0, n % 5), "n_techniques": n % 9, "words": n,
    }
    rows, out = t(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in c.items()]), None
    for by in _BY:
        order = ls.library_order(by, {k: F.col(k) for k in c}, "doc_id")
        top = rows.orderBy(*order).limit(100).select(F.lit(by).alias("by"), F.row_number().over(W.orderBy(*order)).alias("place"), "doc_id")  # a hundred rows
        out = top if out is None else out.union(top)
    return out


_SORT = {"title": "lower(coalesce(title, ''))", "publisher": "lower(source) ", "published": "coalesce(published, DATE '1970-01-01') DESC", "type": "lang", "quality": "quality DESC", "iocs": "coalesce(iocs, 0) DESC", "techniques": "techniques DESC", "ai": "ai DESC, ai_score DESC"}


@query("WITH r AS (SELECT doc_id, substr(text, 1, 5) AS title, source, CASE WHEN doc_id % 5 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 200 AS INT) END AS published, lang, n_chars % 11 AS quality, CASE WHEN doc_id % 6 > 0 THEN n_chars % 5 END AS iocs, n_chars % 9 AS techniques, doc_id % 4 AS ai, n_chars % 13 AS ai_score FROM documents) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS by, row_number() OVER (ORDER BY {o}, doc_id) AS place, doc_id FROM r) WHERE place <= 50" for k, o in _SORT.items()))
def table_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty rows by each column of the table."""
    i, n = F.col("doc_id"), F.col("n_chars")
    c = {
        "title": F.substring("text", 1, 5), "publisher": F.col("source"), "published": F.when(i % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 200).cast("int"))), "type": F.col("lang"),
        "quality": n % 11, "iocs": F.when(i % 6 > 0, n % 5), "techniques": n % 9, "ai": i % 4, "ai_score": n % 13,
    }
    rows, out = t(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in c.items()]), None
    for by in ls.COLUMN_SORTS:
        order = ls.column_order(by, {k: F.col(k) for k in c}, "doc_id")
        top = rows.orderBy(*order).limit(50).select(F.lit(by).alias("by"), F.row_number().over(W.orderBy(*order)).alias("place"), "doc_id")  # fifty rows
        out = top if out is None else out.union(top)
    return out


_ACTORS = "a AS (SELECT s_name AS name, count(*) AS reports, max(CAST(l_shipdate AS DATE)) AS last_seen, count(DISTINCT l_partkey) AS observed, count(DISTINCT l_partkey % 7) AS attributed, round(sum(l_quantity)) % 5 AS activity FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1)"
_ACTOR = {"recent": "activity DESC, last_seen DESC, attributed DESC, lower(name)", "reports": "reports DESC, last_seen DESC, lower(name)", "techniques": "observed DESC, attributed DESC, lower(name)", "name": "lower(name)"}


@query(f"WITH {_ACTORS} " + " UNION ALL ".join(f"SELECT '{k}' AS by, row_number() OVER (ORDER BY {o}) AS place, name FROM a" for k, o in _ACTOR.items()))
def actor_sorts(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers as actors in each of the four orders; ranks of a few rows a supplier table."""
    s, li = t(spark, d, "supplier"), t(spark, d, "lineitem")
    a = s.join(li, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_name").alias("name")).agg(
        F.count("*").alias("reports"), F.max(F.col("l_shipdate").cast("date")).alias("last_seen"), F.countDistinct("l_partkey").alias("observed"), F.countDistinct(F.col("l_partkey") % 7).alias("attributed"), (F.round(F.sum("l_quantity")) % 5).alias("activity")
    )
    out = None
    for by in _ACTOR:
        one = a.select(F.lit(by).alias("by"), F.row_number().over(W.orderBy(*ls.actor_order(by))).alias("place"), "name")
        out = one if out is None else out.union(one)
    return out


_AUDIT = """f AS (SELECT p.page_id, url, length(coalesce(html, '')) % 700 AS words, page_id % 11 / 10.0 AS score, CASE WHEN page_id % 3 = 0 THEN page_id % 4 ELSE 0 END AS iocs, CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END AS cves, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS actors, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages p),
b AS (SELECT page_id, CASE WHEN regexp_matches(path, '^/?$') THEN 'Homepage / Root Index' WHEN iocs = 0 AND cves = 0 AND words < 250 THEN 'Stub (<250 words, 0 artifacts)' WHEN iocs = 0 AND cves = 0 AND words < 350 AND score < 0.45 THEN 'Short News / Zero Technical Artifacts'
WHEN iocs = 0 AND cves = 0 AND score <= 0.1 AND actors = 0 THEN 'Zero Quality Score' WHEN iocs = 0 AND cves = 0 AND actors = 0 THEN 'Zero artifacts' ELSE 'Retained' END AS bucket FROM f)"""


@query(f"WITH {_AUDIT} SELECT bucket, CASE bucket WHEN 'Retained' THEN 'KEEP' ELSE 'PRUNE' END AS action, count(*) AS rows, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM b) AS share FROM b GROUP BY 1")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pages as reports: one bucket each, and the buckets' totals."""
    p = t(spark, d, "pages").where("url IS NOT NULL")
    i = F.col("page_id")
    zero = F.lit(0)
    n = {"iocs": F.when(i % 3 == 0, i % 4).otherwise(zero), "stages": zero, "techniques": zero, "cves": F.when(i % 9 == 0, 1).otherwise(zero), "actors": F.when(i % 7 == 0, 1).otherwise(zero), "malware": zero}
    table = au.rules(F.length(F.coalesce("html", F.lit(""))) % 700, i % 11 / 10, F.col("url"), F.lit(""), n)
    return au.totals(au.audited(p, "page_id", table, {"iocs": n["iocs"] > 0, "cves": n["cves"] > 0, "actors": n["actors"] > 0}))


_PLAN = """s AS (SELECT l_partkey AS id, sum(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.7 ELSE 0.5 END) AS freq, max(CAST(l_shipdate AS DATE)) AS last_seen, max(l_discount * 9 * CASE l_returnflag WHEN 'A' THEN 1.0 ELSE 0.8 END) AS conf FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
p AS (SELECT p_partkey AS id, p_brand AS tactic, p_partkey % 4 = 0 AS attributed, p_partkey % 9 = 0 AS planned, p_partkey % 3 AS options, CAST(p_partkey % 13 AS INT) AS prevalence, p_partkey % 13 / 12.0 AS share, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.5 END AS part_fit FROM part WHERE p_partkey % 5 <> 0),
x AS (SELECT p.*, floor(round(least(1, 0.25 * least(1, coalesce(freq, 0) / 3) + 0.1 * CASE WHEN last_seen IS NULL THEN 0 WHEN DATE '1998-10-01' - last_seen <= 180 THEN 1 WHEN DATE '1998-10-01' - last_seen <= 365 THEN 0.6 WHEN DATE '1998-10-01' - last_seen <= 730 THEN 0.3 ELSE 0.1 END
+ 0.15 * coalesce(conf, 0) + CASE WHEN attributed THEN 0.2 ELSE 0 END + CASE WHEN planned THEN 0.05 ELSE 0 END + CASE WHEN options > 0 THEN 0.1 ELSE 0 END + 0.1 * (0.6 + 0.4 * part_fit) + 0.05 * share) * 100, 6) + 0.5) / 100 AS score FROM p LEFT JOIN s USING (id)),
l AS (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY score DESC, prevalence DESC, CAST(id AS VARCHAR)) = 1 AS leader FROM x),
k AS (SELECT *, row_number() OVER (ORDER BY leader DESC, score DESC, prevalence DESC, tactic, CAST(id AS VARCHAR)) <= 30 AS kept FROM l)"""


@query(f"WITH {_PLAN} SELECT CAST(id AS VARCHAR) AS id, tactic, score, row_number() OVER (ORDER BY tactic, score DESC, CAST(id AS VARCHAR)) AS step FROM k WHERE kept")
def plan_steps(spark: SparkSession, d: str) -> DataFrame:
    """Parts as techniques, brands as tactics, lines as sightings: thirty steps, every tactic led."""
    part, li = t(spark, d, "part"), t(spark, d, "lineitem")
    k = F.col("p_partkey")
    none = F.when(k % 5 == 0, F.array(F.lit("macOS"))).when(k % 2 == 0, F.array(F.lit("Linux"))).otherwise(F.array(F.lit("linux"), F.lit("Windows")))
    tech = part.select(k.cast("string").alias("id"), F.col("p_brand").alias("tactic"), none.alias("platforms"), (k % 4 == 0).alias("attributed"), F.lit(False).alias("chosen"), (k % 9 == 0).alias("planned"), (k % 3).alias("options"), (k % 13).cast("int").alias("prevalence"), (k % 13 / 12).alias("share"))
    label = F.when(F.col("l_returnflag") == "A", "observed").when(F.col("l_returnflag") == "N", "inferred").otherwise("mapped")
    seen = li.where("l_quantity > 40").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_orderkey").alias("report"), label.alias("label"), (F.col("l_discount") * 9).cast("double").alias("confidence"), F.col("l_shipdate").cast("date").alias("day"))
    ranked = pr.scored(tech, seen, "1998-10-01", ["Linux"])
    order = part.select(F.col("p_brand").alias("tactic")).distinct()
    order = order.select("tactic", F.row_number().over(W.orderBy("tactic")).alias("place"))  # a row a brand
    return pr.selected(ranked, order, 30).where("step IS NOT NULL").select("id", "tactic", "score", "step")
