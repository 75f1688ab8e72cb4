"""Text functions, fingerprints and classification over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import dedup as dd
from siftwork.operators import quality as ql
from siftwork.operators import relational as rel
from siftwork.operators import rules as ru
from siftwork.plans.catalog import query
from siftwork.session import stored
from siftwork.session import table as t


@query("""SELECT doc_id, sha256(text) AS sha FROM documents""")
def content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("""SELECT sha256(text) AS sha, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies"))
    return g.where("copies > 1")


@query("""SELECT md5(text) AS g, arg_min(doc_id, (CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END, n_chars % 4 + 1, lang, doc_id)) AS canonical, count(*) AS copies FROM documents GROUP BY 1""")
def canonical_copy(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").withColumn("g", F.md5("text"))
    return dd.canonical(docs, "g", "doc_id", F.col("source"), (F.col("n_chars") % 4 + 1).cast("int"), F.col("lang"), ["src1", "src2"])


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_runs, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents""")
def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = tx.plain_runs(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(r).alias("n_runs"), F.size(F.array_distinct(r)).alias("n_distinct"))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM x GROUP BY 1 ORDER BY df DESC, term LIMIT 100""")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    per = t(spark, d, "documents").select("doc_id", F.explode(tx.plain_runs(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("k"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("k").alias("tf")).orderBy(F.desc("df"), "term").limit(100)


@query("""SELECT doc_id, ip FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'))) AS ip FROM documents)
WHERE list_bool_and(list_transform(string_split(ip, '.'), lambda x: CAST(x AS INT) <= 255)) AND NOT (split_part(ip, '.', 1) IN ('0', '10', '127') OR CAST(split_part(ip, '.', 1) AS INT) >= 224
OR (split_part(ip, '.', 1) = '192' AND split_part(ip, '.', 2) = '168') OR (split_part(ip, '.', 1) = '172' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31)
OR (split_part(ip, '.', 1) = '100' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 64 AND 127) OR (split_part(ip, '.', 1) = '169' AND split_part(ip, '.', 2) = '254')
OR (split_part(ip, '.', 1) = '192' AND split_part(ip, '.', 2) = '0' AND split_part(ip, '.', 3) IN ('0', '2')) OR (split_part(ip, '.', 1) = '198' AND split_part(ip, '.', 2) IN ('18', '19'))
OR (split_part(ip, '.', 1) = '198' AND split_part(ip, '.', 2) = '51' AND split_part(ip, '.', 3) = '100') OR (split_part(ip, '.', 1) = '203' AND split_part(ip, '.', 2) = '0' AND split_part(ip, '.', 3) = '113'))""")
def public_ips(spark: SparkSession, d: str) -> DataFrame:
    ips = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), F.lit(0)))
    return t(spark, d, "documents").select("doc_id", F.explode(ips).alias("ip")).where(tx.is_public_ipv4(F.col("ip")))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\bhxxp(s?)', 'http\\1', 'gi'), '\\s*[\\[({]\\s*(?:[.]|dot)\\s*[\\])}]\\s*', '.', 'gi'), '\\s*[\\[({]\\s*(?:@|at)\\s*[\\])}]\\s*', '@', 'gi') AS text
FROM (SELECT doc_id, concat('hxxps://', replace(text, ' ', '[.]'), ' {at} x(dot)y') AS text FROM documents)""")
def refanged(spark: SparkSession, d: str) -> DataFrame:
    """Defanged forms put into every whole text, and taken out again."""
    bent = F.concat(F.lit("hxxps://"), F.replace("text", F.lit(" "), F.lit("[.]")), F.lit(" {at} x(dot)y"))
    return t(spark, d, "documents").select("doc_id", tx.refang(bent).alias("text"))


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 120 THEN rtrim(substr(x, 1, 120)) || chr(8230) ELSE x END AS excerpt FROM s""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text"), 120).alias("excerpt"))


@query("""SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM pages""")
def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def quotes_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Quotes found in documents: an equi-join on the hash of words that are whole inside a
    quote (from its second, four at most), then a containment test. Quotes under three
    words have no such word and are sought in every text."""
    words = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    b = t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")).where("quote is not null").withColumn("w", words(F.col("quote")))
    b = b.withColumn("size", F.greatest(F.least(F.size("w") - 2, F.lit(4)), F.lit(0)))
    b = b.withColumn("k", F.xxhash64(F.slice("w", F.lit(2), F.col("size")))).drop("w")
    docs = t(spark, d, "documents").select("doc_id", "text")
    sizes = sorted(r[0] for r in b.select("size").distinct().collect())  # five values at most

    def starts(v, n):
        return F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.xxhash64(F.slice(v, i, n)))).otherwise(F.array().cast("array<bigint>"))

    keys = tx.let(words(F.col("text")), lambda v: F.concat(*[starts(v, n) for n in sizes if n] or [F.array().cast("array<bigint>")]))
    hit = docs.select("doc_id", F.explode(keys).alias("k")).join(b.where("size > 0").select("item_id", "k"), "k").select("doc_id", "item_id").distinct()
    found = hit.join(docs, "doc_id").join(b, "item_id").where(F.col("text").contains(F.col("quote"))).select("item_id", "doc_id")
    if 0 in sizes:
        found = found.unionByName(docs.join(b.where("size = 0"), F.col("text").contains(F.col("quote"))).select("item_id", "doc_id"))
    return found


_RUNS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"""WITH n AS (SELECT doc_id, len({_RUNS}) AS k FROM documents)
SELECT l.quality, count(*) AS docs, sum(n.k) AS terms FROM n JOIN labels l USING (doc_id) WHERE n.k > 0 GROUP BY 1""")
def quality_by_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "documents").select("doc_id", F.size(F.array_distinct(tx.plain_runs(F.col("text")))).alias("k"))
    return n.where("k > 0").join(t(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("docs"), F.sum("k").alias("terms"))


_SEEN = ", ".join(f"regexp_matches(text, '{p}') AS {k}_" for k, (p, _) in ql.EVIDENCE.items())
_TERMS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ql.SIGNAL_WORDS)
_ADD = " + ".join(f"CASE WHEN {k}_ THEN {add} ELSE 0 END" for k, (_, add) in ql.EVIDENCE.items())


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'Powershell -enc aGk=; ' WHEN 2 THEN 'HKLM\\Software\\Run C2 and RDP and TTP ' WHEN 3 THEN 'CVE-2024-1234 in stage 2, BYOVD ' WHEN 4 THEN 'ATT&CK T1059, Event ID 4688 ' WHEN 5 THEN 'ransomware, persistence, exfiltration, initial access, mimikatz, C2, IOC, RDP ' ELSE '' END || text AS text FROM documents),
w AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS n, {_TERMS} AS terms, {_SEEN} FROM d)
SELECT doc_id, n AS word_count, floor(round(greatest(0, least(1, 0.22 + CASE WHEN n >= 2500 THEN 0.28 WHEN n >= 1200 THEN 0.2 WHEN n >= 500 THEN 0.1 WHEN command_ OR registry_ OR cve_ THEN 0.16 ELSE -0.12 END
+ CASE WHEN terms >= 8 THEN 0.28 WHEN terms >= 4 THEN 0.18 WHEN terms >= 2 THEN 0.08 ELSE -0.1 END + {_ADD})) * 100, 6) + 0.5) / 100 AS score FROM w""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Every document, most with a kind of evidence put before its text."""
    lead = F.lit("")
    said = ["Powershell -enc aGk=; ", "HKLM\\Software\\Run C2 and RDP and TTP ", "CVE-2024-1234 in stage 2, BYOVD ", "ATT&CK T1059, Event ID 4688 ", "ransomware, persistence, exfiltration, initial access, mimikatz, C2, IOC, RDP "]
    for i, x in enumerate(said, 1):
        lead = F.when(F.col("doc_id") % 6 == i, x).otherwise(lead)
    docs = t(spark, d, "documents").select("doc_id", F.concat(lead, "text").alias("text"))
    return docs.select("doc_id", ql.assessed(F.col("text"), F.lit("")).alias("q")).select("doc_id", "q.word_count", "q.score")


@query(None)
def simhash_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of representatives, and every other document of a hash with its representative
    at distance 0. No SQL: the hash is this library's own. Tested against all pairs on a small table."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source")
    prints = dd.fingerprints(docs, "doc_id", "text", F.split("text", "\n")[0], F.col("source"))
    return dd.near_links(stored(prints.select("doc_id", "simhash", "tokens")), "doc_id")


@query("""WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, greatest(length(text) - 39, 0))), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(substr(text, 40)), '[a-z0-9]+')) AS b FROM documents)
SELECT doc_id, len(a) - len(list_intersect(a, b)) AS lost, len(b) - len(list_intersect(a, b)) AS added FROM x""")
def token_difference(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of whole texts: without their last 39 characters, and without their first."""
    a = tx.plain_runs(F.substr("text", F.lit(1), F.greatest(F.length("text") - 39, F.lit(0))))
    b = tx.plain_runs(F.substr("text", F.lit(40)))
    return t(spark, d, "documents").select("doc_id", rel.token_difference(a, b).alias("x")).select("doc_id", F.size("x.lost").alias("lost"), F.size("x.added").alias("added"))


_W = "regexp_extract_all(lower(text), '\\p{L}+')"


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), h AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the','of','and','to','in','is','that','for','it','with','as','was','on','are','by','this'))) AS en,
len(list_filter(w, lambda x: x IN ('der','die','das','und','ist','nicht','ein','eine','mit','von','zu','auf','für','den','dem'))) AS de,
len(list_filter(w, lambda x: x IN ('le','la','les','des','et','est','une','dans','pour','que','qui','sur','pas','avec','du'))) AS fr FROM w) SELECT doc_id, en, de, fr FROM h""")
def language_markers(spark: SparkSession, d: str) -> DataFrame:
    def hits(lang: str):
        return tx.let(ru.words_of(F.col("text")), lambda w: ru.marker_hits(w, lang))

    return t(spark, d, "documents").select("doc_id", *[hits(k).alias(k) for k in ("en", "de", "fr")])


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '/(?:tags?|categor(?:y|ies)|authors?|archives?|page)(?:/|$)') THEN 'index' WHEN p IN ('', '/') THEN 'shallow' END AS reason
FROM (SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '')) AS p FROM pages)""")
def candidate_urls(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", ru.candidate_url(F.col("url"), F.lit(False)).alias("reason"))


@query("""SELECT doc_id, category, score, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, category) AS rank FROM (SELECT *, max(r) OVER (PARTITION BY doc_id) AS best FROM (
SELECT doc_id, category, sum(weight * least(len(regexp_extract_all(lower(text), pattern)), cap)) + 0.0 AS score, sum(weight * least(len(regexp_extract_all(lower(text), pattern)), cap)) / max(threshold) AS r
FROM documents, (VALUES ('a', 'tion', 1.0, 20, 5.0), ('a', 'ing', 0.5, 10, 5.0), ('b', 'eau', 1.0, 20, 5.0), ('c', 'sch', 1.0, 20, 5.0)) s(category, pattern, weight, cap, threshold) GROUP BY 1, 2 HAVING sum(weight * least(len(regexp_extract_all(lower(text), pattern)), cap)) >= max(threshold)))
WHERE r >= 0.3 * best QUALIFY rank <= 4""")
def taxonomy_labels(spark: SparkSession, d: str) -> DataFrame:
    signals = spark.createDataFrame([("a", "tion", 1.0, 20, 5.0), ("a", "ing", 0.5, 10, 5.0), ("b", "eau", 1.0, 20, 5.0), ("c", "sch", 1.0, 20, 5.0)], "category string, pattern string, weight double, cap int, threshold double")
    return ru.taxonomy(t(spark, d, "documents").withColumn("title", F.lit("")), signals)


@query("""SELECT conv_id, turn, length(trim(text)) <= 4 OR regexp_matches(lower(trim(text)), '^(?:hi|hello|hey|thanks?|thank you|ok(?:ay)?|bye|good (?:morning|evening)|merci|danke|gracias)\\b[\\s!.,]*$') AS small_talk FROM conversations""")
def conversational_turns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", ru.conversational(F.col("text")).alias("small_talk"))
