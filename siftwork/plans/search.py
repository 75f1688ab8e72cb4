"""Search over documents: title is the first line, body the rest, source the publisher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import engine as en
from siftwork.operators import facets as fc
from siftwork.operators import search as sr
from siftwork.operators.textindex import WEIGHTS, TextIndex
from siftwork.plans.catalog import query
from siftwork.session import kept_dir
from siftwork.session import table as t

WANTED = ["thble", "anthe", "eaux", "schung", "tionen"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").withColumn("title", F.split("text", "\n")[0])


_BM = """x AS (SELECT doc_id, 'title' AS field, 3.0 AS w, 0.5 AS b, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+') AS terms FROM documents
UNION ALL SELECT doc_id, 'body', 1.0, 0.75, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
avgs AS (SELECT field, greatest(avg(len(terms)), 1) AS a FROM x GROUP BY 1), q AS (SELECT unnest(['thble', 'anthe', 'eaux', 'schung', 'tionen']) AS term),
tf AS (SELECT doc_id, term, sum(w * tf / (1 - b + b * n / a)) AS tfw FROM (SELECT x.doc_id, x.field, x.w, x.b, len(x.terms) AS n, q.term, len(list_filter(x.terms, lambda v: v = q.term)) AS tf FROM x, q) JOIN avgs USING (field) WHERE tf > 0 GROUP BY 1, 2),
df AS (SELECT term, greatest(0.2, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf GROUP BY 1),
s AS (SELECT doc_id, sum(idf * tfw / (1.4 + tfw)) * (0.5 + 0.5 * count(*) / 5) AS score, count(*) AS n_hits FROM tf JOIN df USING (term) GROUP BY 1)"""


FIELDS = {"title": WEIGHTS["title"], "actors": WEIGHTS["actors"], "body": WEIGHTS["body"]}


def _columns() -> dict[str, Column]:
    return {"title": F.col("title"), "actors": F.col("source"), "body": F.col("text")}


def _index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of documents: made by the first search, read by all others."""
    index = TextIndex(spark, kept_dir(spark, t(spark, d, "documents"), "textindex"), FIELDS, split=tx.plain_runs)
    if not index.version():
        index.add(_docs(spark, d), _columns())
    return index


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).scored(WANTED, {k: sr.FIELDS[k] for k in ("title", "body")})


_WEIGHTED = """f AS (SELECT doc_id, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+') AS a, regexp_extract_all(lower(source), '[a-z0-9]+') AS b, regexp_extract_all(lower(text), '[a-z0-9]+') AS c FROM documents),
w AS (SELECT doc_id, 10.0 * len(list_filter(a, lambda v: v IN {0})) + 8.0 * len(list_filter(b, lambda v: v IN {0})) + 2.0 * len(list_filter(c, lambda v: v IN {0})) AS score FROM f)"""


@query(f"WITH {_WEIGHTED.format("('thble', 'anthe')")} SELECT doc_id, score FROM w WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25")
def weighted_top25(spark: SparkSession, d: str) -> DataFrame:
    """Sums of weighted counts, from the stored index alone."""
    return _index(spark, d).top(["thble", "anthe"], 25).withColumnRenamed("key", "doc_id")


@query(f"WITH {_WEIGHTED.format("('thble', 'eaux', 'src1')")} SELECT doc_id, score FROM w WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25")
def weighted_top25_merged(spark: SparkSession, d: str) -> DataFrame:
    """As above, from an index of two batches of which the second replaces documents of the first."""
    index = TextIndex(spark, kept_dir(spark, t(spark, d, "documents"), "textindex-merged"), FIELDS, split=tx.plain_runs)
    docs, again = _docs(spark, d), (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0)
    if index.version() < 1:
        older = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" thble eaux old"))).otherwise(F.col("text")))
        index.add(older, _columns())
    if index.version() < 2:
        index.add(docs.where(again), _columns())
    return index.top(["thble", "eaux", "src1"], 25).withColumnRenamed("key", "doc_id")


@query(f"""WITH {_WEIGHTED.format("('anthe', 'tionen')")}, i AS (SELECT doc_id, 1000.0 AS score, 'exact_id' AS matched_by FROM documents WHERE source = 'src7' ORDER BY doc_id LIMIT 40),
a AS (SELECT * FROM i UNION ALL SELECT * FROM (SELECT doc_id, score, 'text' FROM w WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40) WHERE doc_id NOT IN (SELECT doc_id FROM i))
SELECT doc_id, score, matched_by FROM a ORDER BY matched_by <> 'exact_id', score DESC, doc_id LIMIT 40""")
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry the asked identifier themselves, then the best by weighted counts."""
    return _index(spark, d).candidates(["anthe", "tionen"], ["src7"], ["actors"], 40).withColumnRenamed("key", "doc_id")


@query(f"WITH {_BM} SELECT s.doc_id, round(score, 6) AS score, n_hits FROM s JOIN documents USING (doc_id) WHERE lang <> 'es' ORDER BY score DESC, doc_id LIMIT 20")
def search_bm25_top20(spark: SparkSession, d: str) -> DataFrame:
    out = _scored(spark, d).join(t(spark, d, "documents").where("lang <> 'es'").select("doc_id"), "doc_id")
    return out.select("doc_id", F.round("score", 6).alias("score"), "n_hits").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH {_BM}, r AS (SELECT s.doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, s.doc_id) AS k FROM s JOIN documents USING (doc_id))
SELECT doc_id, source, round(round(score, 6) * pow(0.85, k - 1), 6) AS adjusted FROM r ORDER BY adjusted DESC, doc_id LIMIT 30""")
def search_publisher_diversity(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("score", F.round("score", 6)).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    out = sr.diversify(s, "source", "score", "doc_id").select("doc_id", "source", F.round("adjusted", 6).alias("adjusted"))
    return out.orderBy(F.desc("adjusted"), "doc_id").limit(30)


@query(f"""WITH {_BM}, r AS (SELECT s.doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY md5(text) ORDER BY round(score, 6) DESC, s.doc_id) AS k, count(*) OVER (PARTITION BY md5(text)) AS copies FROM s JOIN documents USING (doc_id))
SELECT doc_id, score, copies FROM r WHERE k = 1""")
def search_collapse_copies(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("score", F.round("score", 6)).join(t(spark, d, "documents").select("doc_id", F.md5("text").alias("same")), "doc_id")
    return sr.collapse(s, "doc_id", "score", "same").select("doc_id", "score", "copies")


@query(f"WITH {_BM} SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s JOIN documents USING (doc_id) GROUP BY 2")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("doc_id").join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return fc.facet_set(s, {"lang": F.array("lang"), "source": F.array("source")})


@query("""SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src3' AND contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the') AND NOT regexp_matches(regexp_replace(lower(text), '\\s+', ' ', 'g'), '(^|[^a-z0-9])shthe([^a-z0-9]|$)')""")
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    q = sr.interpret('lang:en,fr -source:src3 "of the" -shthe')
    docs = t(spark, d, "documents")
    return docs.where(sr.passes(q, {"lang": F.array("lang"), "source": F.array("source")}, tx.flatten_text(F.col("text")))).select("doc_id")


@query("""WITH l AS (SELECT d.doc_id, (0.85 + 0.15 * 0.6) * CASE n_chars % 4 WHEN 1 THEN 1.06 WHEN 2 THEN 1.04 WHEN 3 THEN 1.0 ELSE 1 END * (0.9 + 0.1 * coalesce(quality, 0.5)) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, round(m, 9) AS m FROM l""")
def search_priors(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    m = sr.priors(F.lit(None).cast("double"), (F.col("n_chars") % 4).cast("int"), F.col("quality").cast("double"), F.lit(None).cast("date"), "2024-01-01")
    return docs.select("doc_id", F.round(m, 9).alias("m"))


@query(None)
def search_passages(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: where passages end is decided text by text. Tested for exact offsets."""
    return sr.select_passages(sr.passages(t(spark, d, "documents").select("doc_id", "text")), WANTED)


_MULT = "(0.85 + 0.15 * 0.6) * CASE n_chars % 4 WHEN 1 THEN 1.06 WHEN 2 THEN 1.04 WHEN 3 THEN 1.0 ELSE 1 END * (0.9 + 0.1 * 0.5)"
_UNI = f"""{_BM}, y AS (SELECT s.doc_id, CASE WHEN lang = 'de' THEN 'knowledge' ELSE 'report' END AS kind, source, lang, md5(text) AS same,
round((score + CASE WHEN n_chars % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN source = 'src1' THEN 0.8 ELSE 0 END) * {_MULT}, 6) AS score FROM s JOIN documents USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY same) AS copies FROM y), o AS (SELECT * FROM c WHERE k = 1), l AS (SELECT * FROM o WHERE lang IN ('en', 'de'))"""


def _unified(spark: SparkSession, d: str, limit: int = 20, offset: int = 10, spread: int = en.SPREAD) -> en.Found:
    docs = t(spark, d, "documents")
    n = F.col("n_chars")
    parts = {"intent": F.when(n % 5 == 0, en.BOOSTS["intent"]).otherwise(0.0), "tactic": F.when(F.col("source") == "src1", en.BOOSTS["tactic"]).otherwise(0.0)}
    prior = sr.priors(F.lit(None).cast("double"), (n % 4).cast("int"), F.lit(0.5), F.lit(None).cast("date"), "2024-01-01")
    kind = F.when(F.col("lang") == "de", "knowledge").otherwise("report")
    return en.run_search(
        _scored(spark, d), docs, "doc_id", kind, F.col("source"), F.md5("text"), prior, {"lang": F.array("lang"), "source": F.array("source")}, {"lang": ["EN", "de"]}, limit, offset, en.boosts(docs, "doc_id", parts), spread
    )


@query(f"""WITH {_UNI}, h AS (SELECT * FROM l ORDER BY score DESC, doc_id LIMIT 200), g AS (SELECT *, score * pow(0.85, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) - 1) AS adjusted FROM h),
r AS (SELECT row_number() OVER (ORDER BY round(adjusted, 6) DESC, doc_id) AS rank, doc_id, kind, source AS publisher, round(adjusted, 6) AS score, copies FROM g) SELECT * FROM r WHERE rank BETWEEN 11 AND 30""")
def search_unified(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d).page


@query(f"""WITH {_UNI}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k0 FROM l), g AS (SELECT *, CASE WHEN k0 <= 15 THEN score * pow(0.85, row_number() OVER (PARTITION BY source, k0 <= 15 ORDER BY score DESC, doc_id) - 1) ELSE score END AS adjusted FROM n),
r AS (SELECT row_number() OVER (ORDER BY k0 > 15, round(adjusted, 6) DESC, doc_id) AS rank, doc_id, kind, source AS publisher, round(adjusted, 6) AS score, copies FROM g) SELECT * FROM r WHERE rank BETWEEN 11 AND 50""")
def search_unified_tail(spark: SparkSession, d: str) -> DataFrame:
    """A page that begins among the rows whose publishers are spread and goes on in the tail."""
    return _unified(spark, d, 40, 10, 15).page


@query(f"""WITH {_UNI} SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM o GROUP BY 2""")
def search_unified_facets(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d).facets


@query(f"""WITH {_UNI} SELECT kind, count(*) AS n FROM l GROUP BY 1""")
def search_unified_counts(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d).counts


@query(f"""WITH {_BM} SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms, CAST(sum(CASE WHEN in_title THEN 2 ELSE 1 END) AS BIGINT) AS n_fields FROM (SELECT x.doc_id, q.term, bool_or(field = 'title') AS in_title FROM x, q WHERE list_contains(x.terms, q.term) GROUP BY 1, 2) GROUP BY 1""")
def search_why(spark: SparkSession, d: str) -> DataFrame:
    terms = _index(spark, d).matched(WANTED).where("field <> 'actors'")
    w = en.why(terms, WANTED, "doc_id")
    n = F.aggregate("matched", F.lit(0), lambda a, m: a + F.size(m["fields"]))
    return w.select("doc_id", F.array_join(F.transform("matched", lambda m: m["term"]), ",").alias("terms"), n.cast("bigint").alias("n_fields"))


@query(f"""WITH {_BM} SELECT doc_id, n_hits FROM s WHERE n_hits >= 2""")
def search_gate(spark: SparkSession, d: str) -> DataFrame:
    """Five signal terms ask for two hits."""
    return en.relevant(_scored(spark, d), WANTED).select("doc_id", "n_hits")


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents), a AS (SELECT doc_id, x, coalesce(nullif(strpos(lower(x), 'thble'), 0), nullif(strpos(lower(x), 'eaux'), 0), 1) AS pos FROM f)
SELECT doc_id, trim(substr(x, greatest(pos - 130, 1), 260)) AS snippet FROM a""")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", en.snippet(F.col("text"), ["thble", "eaux"]).alias("snippet"))


@query("""SELECT doc_id, round(CASE WHEN m > 0 THEN 4 * (1 + least(1, log2(1 + m) / 3)) ELSE 0 END + CASE WHEN h THEN 1 ELSE 0 END, 9) AS boost FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'thble')) AS m, contains(lower(string_split(text, chr(10))[1]), 'thble') AS h FROM documents)""")
def entity_boosts(spark: SparkSession, d: str) -> DataFrame:
    m = F.regexp_count(F.lower("text"), F.lit("thble"))
    return _docs(spark, d).select("doc_id", F.round(en.mention_boost(m, F.lower("title").contains("thble")), 9).alias("boost"))
