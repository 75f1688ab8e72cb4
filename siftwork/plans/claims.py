"""Phrases, headings, sentences and targeting over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators import context as cx
from siftwork.operators import evidence as ev
from siftwork.operators import extract as ex
from siftwork.operators import graph as g
from siftwork.operators import grounding as gd
from siftwork.operators import phrases as ph
from siftwork.operators import qualify as qy
from siftwork.operators import searchdocs as sd
from siftwork.plans.catalog import query
from siftwork.plans.graph import _EDGES, _LINKS, facts
from siftwork.session import stored
from siftwork.session import table as t

_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[‘’`´]', '''', 'g'), '[^a-z0-9.''/ -]+', ' ', 'g'), '[-/]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT string_split({_NORMAL}, ' ') AS w FROM benchmark), q AS (SELECT DISTINCT array_to_string(w[i : i + 3], ' ') AS phrase FROM (SELECT w, unnest([1, 2, 5]) AS i FROM b) WHERE len(w) >= i + 3),
d AS (SELECT doc_id, string_split({_NORMAL}, ' ') AS w FROM documents), r AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i : i + 3], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d))
SELECT doc_id, phrase, count(*) AS n, min(place) AS first FROM r JOIN q USING (phrase) GROUP BY 1, 2""")
def benchmark_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Runs of four words of benchmark items, wherever documents have them: an automaton over whole texts."""
    words = t(spark, d, "benchmark").select(F.split(ph.normal(F.col("text")), " ").alias("w"))
    starts = F.filter(F.array(*map(F.lit, (1, 2, 5))), lambda i: F.size("w") >= i + 3)
    said = words.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("phrase")).distinct()
    return ph.find(t(spark, d, "documents").select("doc_id", "text"), said.withColumn("id", F.col("phrase"))).select("doc_id", "phrase", "n", "first")


@query("""WITH p AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS id, p_name AS name, string_split(p_name, ' ') AS w FROM part GROUP BY p_name), a AS (SELECT w[2] || ' ' || w[1] AS phrase, w FROM p WHERE len(w) = 2 AND w[1] <> w[2]),
h AS (SELECT phrase, id, len(p.w) AS size, count(*) OVER (PARTITION BY phrase) AS hits FROM a JOIN p ON list_has_all(p.w, a.w) WHERE phrase NOT IN (SELECT name FROM p)),
m AS (SELECT phrase, id, hits, row_number() OVER (PARTITION BY phrase ORDER BY id) AS r FROM (SELECT *, min(size) OVER (PARTITION BY phrase) AS least FROM h) WHERE size = least)
SELECT phrase, id, 'token-cover' AS via FROM m WHERE hits <= 3 AND r <= 2 UNION ALL SELECT name, id, 'name' FROM p""")
def covered_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as they are, and turned round: such a phrase is covered by a name.
    SQL states it for names whose words the stemmer leaves alone, as all of these are."""
    names = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id"))
    w = F.split("name", " ")
    turned = names.where((F.size(w) == 2) & (w[0] != w[1])).select(F.concat(w[1], F.lit(" "), w[0]).alias("phrase"))
    asked = names.select(F.col("name").alias("phrase")).unionByName(turned)
    return ph.match_phrases(asked, names, spark.createDataFrame([], "phrase string, id string"))


HEADINGS = ["Mitigation guidance", "Identity", "Overview", "Hunting queries", "Lateral Movement", "Hosts of the group", "Defense Evasion"]
_HEAD = "CASE (doc_id + n) % 11 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADINGS)) + " ELSE 'Part' END"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents), h AS (SELECT doc_id, n, {_HEAD} AS heading FROM l),
f AS (SELECT *, regexp_matches(heading, '{ev.DEFENSIVE_HEADING}') AS opens, regexp_matches(heading, '{ev.NARRATIVE_HEADING}') AS ends FROM h),
p AS (SELECT *, last_value(CASE WHEN opens THEN heading WHEN ends THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM f)
SELECT doc_id, n, heading, CASE WHEN NOT opens AND NOT ends AND coalesce(parent, '') <> '' THEN parent || ' › ' || heading ELSE heading END AS context FROM p""")
def heading_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a heading of some kind, and the defensive part that it still stands under."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    heading = F.lit("Part")
    for i, h in enumerate(HEADINGS):
        heading = F.when((F.col("doc_id") + F.col("n")) % 11 == i, h).otherwise(heading)
    return ev.contexts(lines.select("doc_id", F.col("n").cast("bigint").alias("n"), heading.alias("heading")), at="n").select("doc_id", "n", "heading", "context")


@query(None)
def labelled_sentences(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: its patterns look ahead. Tested against a sequential version of each rule."""
    return ev.label_sentences(t(spark, d, "documents").select("doc_id", "text"))


@query("""WITH s AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'defensive' WHEN 2 THEN 'negated' ELSE 'reference' END AS label FROM conversations), n(kind, name) AS (VALUES ('sector', 'of the'), ('objective', 'and'), ('platform', 'in')),
h AS (SELECT conv_id, turn, kind, name, CASE WHEN kind = 'objective' THEN CASE WHEN label = 'observed' THEN 'targeted' ELSE 'mentioned' END WHEN label = 'defensive' THEN 'at_risk' ELSE 'mentioned' END AS status
FROM s, n WHERE label <> 'reference' AND contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' ' || name || ' '))
SELECT conv_id, kind, name, CASE max(CASE status WHEN 'targeted' THEN 2 WHEN 'at_risk' THEN 1 ELSE 0 END) WHEN 2 THEN 'targeted' WHEN 1 THEN 'at_risk' ELSE 'mentioned' END AS status, count(*) AS mentions FROM h GROUP BY 1, 2, 3""")
def conversation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Names of one word or two in whole turns, with the strongest status of each."""
    c = t(spark, d, "conversations")
    label = F.when(c.turn % 4 == 0, "observed").when(c.turn % 4 == 1, "defensive").when(c.turn % 4 == 2, "negated").otherwise("reference")
    said = c.where("text IS NOT NULL").select("conv_id", F.col("turn").alias("n"), F.col("text").alias("sentence"), label.alias("label"))
    names = spark.createDataFrame([("sector", "of the"), ("objective", "and"), ("platform", "in")], "kind string, name string")
    return ev.targeting(said, names, "conv_id").select("conv_id", "kind", "name", "status", "mentions")


_ALIASES = [("group", "G1", "thble"), ("group", "G1", "anthe"), ("software", "S1", "eaux"), ("group", "G2", "schung"), ("group", "G2", "tionen"), ("group", "G3", "src1")]


@query(f"""WITH a(kind, eid, alias) AS (VALUES {", ".join(map(str, _ALIASES))}), d AS (SELECT doc_id, source, regexp_extract_all(string_split(text, chr(10))[1] || chr(10) || text, '[\\p{{L}}\\p{{N}}_-]+') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, kind, eid, alias, len(list_filter(w, lambda x: CASE WHEN alias = 'src1' THEN lower(x) ELSE x END = alias)) AS n, 0 AS later FROM d, a UNION ALL SELECT doc_id, kind, eid, alias, 1, 1 FROM documents JOIN a ON alias = source)
SELECT CAST(doc_id AS VARCHAR) AS id, kind, eid, arg_min(alias, (later, -n, alias)) AS via, sum(n) AS count FROM c WHERE n > 0 GROUP BY ALL""")
def document_entities(spark: SparkSession, d: str) -> DataFrame:
    """Search documents of all documents, their sources as stored actors: the entities of each."""
    docs = t(spark, d, "documents")
    aliases = spark.createDataFrame(_ALIASES, "kind string, id string, alias string")
    entities = aliases.groupBy("kind", "id").agg(F.min("alias").alias("name"))
    reports = docs.select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), "text")
    stated = docs.select(F.col("doc_id").alias("report"), F.lit("group").alias("kind"), F.col("source").alias("value"))
    none = spark.createDataFrame([], "id string, tactics array<string>")
    found = sd.report_docs(reports, stated, entities, aliases, none)
    return found.select("id", F.explode("entities").alias("e")).select("id", "e.kind", F.col("e.id").alias("eid"), "e.via", "e.count")


_LINKED = "CASE i % 4 WHEN 0 THEN '[' || l || '](http://x/(a)b)' WHEN 1 THEN '- [go](http://y) | [on](z)' WHEN 2 THEN lower(l) ELSE 'see [this](u) ' || l END"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents), b AS (SELECT doc_id, i, trim({_LINKED}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM l),
k AS (SELECT * FROM b WHERE l <> '' AND NOT (regexp_matches(l, '\\[([^\\]]*)\\]\\((?:[^()\\s]|\\([^()\\s]*\\))+\\)') AND length(regexp_replace(regexp_replace(regexp_replace(l, '\\[([^\\]]*)\\]\\((?:[^()\\s]|\\([^()\\s]*\\))+\\)', '', 'g'), '^(?:[-*•]|\\d{{1,3}}[.)])\\s*', ''), '[\\s|·,;:•–—-]+', '', 'g')) <= 3)),
v AS (SELECT doc_id, i, regexp_replace(l, '\\[([^\\]]*)\\]\\((?:[^()\\s]|\\([^()\\s]*\\))+\\)', '\\1', 'g') AS l FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(l) ORDER BY i) AS r FROM v)
SELECT d.doc_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS prose FROM documents d LEFT JOIN (SELECT * FROM f WHERE r = 1) f USING (doc_id) GROUP BY 1""")
def prose_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents turned into links, lists of links, small letters and lines with a link."""
    rows = t(spark, d, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda l, i: F.when(i % 4 == 0, F.concat(F.lit("["), l, F.lit("](http://x/(a)b)"))).when(i % 4 == 1, F.lit("- [go](http://y) | [on](z)")).when(i % 4 == 2, F.lower(l)).otherwise(F.concat(F.lit("see [this](u) "), l))).alias("ls"))
    return ex.article_prose(rows.select("doc_id", F.array_join("ls", "\n").alias("text")))


@query("""SELECT doc_id, 0 AS n, substr(text, 11, 60) AS found, 10 AS start, 70 AS "end" FROM documents WHERE length(text) >= 80 AND regexp_matches(substr(text, 11, 60), '^[a-z][a-z ,]*[a-z]$') AND NOT contains(substr(text, 11, 60), '  ') AND strpos(lower(text), lower(substr(text, 11, 60))) = 11""")
def quotes_placed(spark: SparkSession, d: str) -> DataFrame:
    """A stretch of every document, written in capitals and with marks, is found at its place.
    Stretches that stand earlier in their text too are left to the tests."""
    docs = t(spark, d, "documents").where("length(text) >= 80")
    own = F.substring("text", 11, 60)
    plain = docs.where(own.rlike("^[a-z][a-z ,]*[a-z]$") & ~own.contains("  ") & F.expr("instr(lower(text), lower(substring(text, 11, 60))) = 11"))
    quotes = plain.select("doc_id", F.lit(0).alias("n"), F.concat(F.lit("“"), F.replace(F.upper(own), F.lit(" "), F.lit(" **")), F.lit("”")).alias("quote"))
    hit = gd.ground_quotes(docs.select("doc_id", "text"), quotes).join(plain.select("doc_id", own.alias("own")), "doc_id")
    return hit.select("doc_id", F.col("n").cast("int").alias("n"), F.col("own").alias("found"), "start", "end")


def _kinds(e: DataFrame) -> DataFrame:
    ends = e.select(F.col("source").alias("node"), F.lit("supplier").alias("type")).union(e.select(F.col("target").alias("node"), F.lit("part").alias("type")))
    return ends.distinct()


@query(f"""WITH {_EDGES}, dbl AS (SELECT source AS node, target AS peer, s FROM es UNION ALL SELECT target, source, s FROM es),
first AS (SELECT node AS seed, peer AS mid, s AS s1 FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, peer) AS r FROM dbl WHERE node LIKE 's%') WHERE r <= 60), deg AS (SELECT node AS mid, 1 / log2(2 + count(*)) AS damp FROM dbl GROUP BY 1),
far AS (SELECT seed, a.peer, sum(s1 * a.s * damp) AS x FROM first JOIN deg USING (mid) JOIN dbl a ON a.node = first.mid WHERE a.peer <> seed GROUP BY 1, 2),
z AS (SELECT *, max(x) OVER (PARTITION BY seed) AS top, row_number() OVER (PARTITION BY seed ORDER BY round(x, 9) DESC, peer) AS rank FROM far)
SELECT seed, rank, peer, floor(round(x / top * 100, 6) + 0.5) / 100 AS score FROM z WHERE rank <= 10""")
def entity_related(spark: SparkSession, d: str) -> DataFrame:
    """The ten most related suppliers of every supplier, in one job."""
    e = stored(g.edges(facts(spark, d)))
    seeds = e.select(F.col("source").alias("seed")).distinct()
    return cx.related(e, _kinds(e), seeds).select("seed", "rank", "peer", "score")


@query(f"""WITH {_LINKS}, p AS (SELECT a.node AS seed, b.node, count(*) AS shared, sum(a.w) AS w FROM lw a JOIN lw b ON a.feature = b.feature WHERE a.node <> b.node GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT seed, p.node, shared, floor(round(w / (ta.t + tb.t - w) * 100, 6) + 0.5) / 100 AS score FROM p JOIN tot ta ON ta.node = seed JOIN tot tb ON tb.node = p.node WHERE w / (ta.t + tb.t - w) >= 0.01),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, shared DESC, node) AS rank FROM s) SELECT seed, rank, node, shared, score FROM r WHERE rank <= 6""")
def entity_similar(spark: SparkSession, d: str) -> DataFrame:
    """The six most similar suppliers of every supplier, in one job."""
    pairs = stored(facts(spark, d).select(F.col("source").alias("node"), F.col("target").alias("feature")).distinct())
    return cx.similar(pairs, pairs.select(F.col("node").alias("seed")), least_score=0.01)


@query(f"""WITH {_EDGES}, dbl AS (SELECT source AS seed, 'part' AS type, target AS peer, s, stated, weight FROM es UNION ALL SELECT target, 'supplier', source, s, stated, weight FROM es),
x AS (SELECT *, row_number() OVER (PARTITION BY seed, type ORDER BY s DESC, peer) AS r FROM dbl), n AS (SELECT seed, type, count(*) AS total FROM dbl GROUP BY 1, 2)
SELECT seed, type, total, string_agg(peer, ',' ORDER BY r) AS peers FROM x JOIN n USING (seed, type) WHERE r <= 8 GROUP BY 1, 2, 3""")
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """The eight strongest links of every node."""
    e = stored(g.edges(facts(spark, d)))
    nodes = _kinds(e)
    found = cx.links(e, nodes, nodes.select(F.col("node").alias("seed")))
    return found.select("seed", "type", "total", F.array_join(F.transform("items", lambda x: x["peer"]), ",").alias("peers"))


_LEADS = [
    "",
    "powershell -enc aGk0 now; \ncmd.exe /c whoami all\nschtasks /create x y\ncertutil -urlcache z\n",
    "Event ID 4688 in C:\\Windows\\Temp\\abcd.txt and HKLM\\Software\\Runs. kill chain; byovd\n",
    "CVE-2024-1234 by a threat actor, APT29, with a payload, a dropper, ransomware and exploit\n",
    "Request a demo or start your free trial. Contact sales\n",
    "T1059.001 and 10.1.2.3 were named: initial access, persistence, exfiltration\n",
    "malware analysis of a loader, a beacon and an infostealer\n",
]
_LEAD = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {' || chr(10) || '.join(chr(39) + x + chr(39) for x in lead.split(chr(10)))}" for i, lead in enumerate(_LEADS)) + " END"


def _points(rows: list[tuple], columns: dict[str, str]) -> str:
    """SQL of the points of a table of rules: of rows of one fact the first that holds."""
    by: dict[str, list] = {}
    for fact, least, add, _ in rows:
        by.setdefault(fact, []).append(f"WHEN {columns[fact]} >= {least} THEN {add}")
    return " + ".join(f"CASE {' '.join(w)} ELSE 0 END" for w in by.values())


def _many(kind: str) -> str:
    found = f"list_transform(regexp_extract_all(prose, '{qy.EVIDENCE[kind]}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))"
    if kind == "commands":
        found = f"list_filter(list_transform({found}, lambda x: regexp_replace(x, '^[`''\"]+|[`''\"]+$', '', 'g')), lambda x: length(x) > 8 AND NOT contains(x, '<') AND NOT contains(x, '>'))"
    return f"least({qy.LISTED[kind]}, len(list_distinct({found})))"


_FACTS = {"commands": "nc", "registry": "nr", "paths": "np", "events": "ne", "artifacts": "nr + np", "phases": "CAST(phases AS INT)", "emerging": "CASE WHEN emerging IS NULL THEN 0 ELSE 1 END", "words": "words", "terms": "terms", "technique": "CAST(tech AS INT)", "cve": "CAST(cve AS INT)", "indicator": "CAST(ioc AS INT)", "replay": "round(simulation * 100)"}
_TERM = " + ".join("CAST(regexp_matches(low, '(?:^|[^a-z0-9])" + t.replace(".", "\\.").replace("&", "\\&").replace("-", "\\-") + ("" if t.endswith("-") else "(?:[^a-z0-9]|$)") + "') AS INT)" for t in qy.TERMS)
_NEW = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in qy.EMERGING.items()) + " END"
_NOISE = " + ".join(f"CAST(regexp_matches(both_, '{p}') AS INT)" for p in qy.MARKETING)
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}')" + (f" OR {_FACTS[enough[0]]} >= {enough[1]}" if enough else "") + f" THEN '{n}:{k}'" for n, k, p, enough, _ in qy.CLASSES) + f" ELSE '{':'.join(qy.OTHERWISE)}' END"


@query(f"""WITH d AS (SELECT doc_id, {_LEAD} || coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS raw FROM d),
t AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY i) AS r FROM t WHERE line <> ''),
p AS (SELECT d.doc_id, text, chr(10) || text AS both_, coalesce(prose, '') AS prose, lower(coalesce(prose, '')) AS low FROM d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS prose FROM u WHERE r = 1 GROUP BY 1) USING (doc_id)),
f AS (SELECT doc_id, low, {_many("commands")} AS nc, {_many("registry")} AS nr, {_many("paths")} AS np, {_many("events")} AS ne, regexp_matches(prose, '{qy.FLAGS["cve"]}') AS cve, regexp_matches(prose, '{qy.FLAGS["technique"]}') AS tech, regexp_matches(prose, '{qy.FLAGS["indicator"]}') AS ioc,
{_NEW} AS emerging, {_NOISE} AS noise, regexp_matches(both_, '{qy.CONFERENCE}') AS paper, regexp_matches(low, '{qy.PHASES}') AS phases, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS words, {_TERM} AS terms FROM p),
s AS (SELECT *, {_CLASS} AS class, floor(round(least(1, CASE WHEN noise > 0 THEN greatest(0.1, {qy.BASE_SIMULATION} + {_points(qy.SIMULATION, _FACTS)} - 0.05) ELSE {qy.BASE_SIMULATION} + {_points(qy.SIMULATION, _FACTS)} END) * 100, 6) + 0.5) / 100 AS simulation FROM f),
g AS (SELECT *, floor(round(least(1, {qy.BASE} + {_points(qy.QUALITY, _FACTS)}) * 100, 6) + 0.5) / 100 AS score, nc + nr + np + ne AS total, nc > 0 OR nr > 0 OR ne > 0 OR cve OR ioc AS sub FROM s),
o AS (SELECT *, CASE WHEN words < 200 AND NOT sub THEN 1 WHEN noise >= 2 AND NOT paper AND total = 0 THEN 2 WHEN NOT (sub OR tech OR (terms >= 3 AND words >= 350)) THEN 3 ELSE 0 END AS gone FROM g)
SELECT doc_id, gone = 0 AND (score >= 0.3 OR simulation >= 0.4 OR sub) AS permissive, gone = 0 AND (score >= 0.4 OR simulation >= 0.5) AND (sub OR terms >= 2) AS balanced, gone = 0 AND (score >= 0.65 OR simulation >= 0.6) AND (total >= 1 OR terms >= 3) AS strict,
CASE gone WHEN 1 THEN 0.15 WHEN 2 THEN 0.18 WHEN 3 THEN least(score, 0.3) ELSE score END AS score, CASE gone WHEN 0 THEN simulation WHEN 3 THEN 0.1 ELSE 0.05 END AS simulation, CASE gone WHEN 0 THEN class WHEN 1 THEN 'OTHER:VULNERABILITY_ADVISORY' ELSE 'GENERIC_NEWS:CAMPAIGN_INTEL' END AS class, noise, emerging FROM o""")
def qualified_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document, most with evidence, phases, noise or terms put before its text, at three levels."""
    lead = F.lit("")
    for i, x in enumerate(_LEADS):
        lead = F.when(F.col("doc_id") % 7 == i, x).otherwise(lead)
    docs = t(spark, d, "documents").select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"), F.lit("").alias("title"))
    found = qy.qualify(docs)
    return found.select("doc_id", "qualified.*", "score", "simulation", F.concat("classification", F.lit(":"), "kind").alias("class"), "noise", "emerging")
