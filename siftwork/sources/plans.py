"""Search results, plan indexes and attack-flow files, read with JSON and text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "array<struct<url:string,title:string,snippet:string>>"


def json_results(body: Column) -> Column:
    """Results of the two common JSON shapes: results[] with content, and web.results[] with description."""
    a = F.from_json(body, "results array<struct<url:string,title:string,content:string>>")["results"]
    b = F.from_json(body, "web struct<results:array<struct<url:string,title:string,description:string>>>")["web"]["results"]
    first = F.transform(a, lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["content"].alias("snippet")))
    second = F.transform(b, lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["description"].alias("snippet")))
    return F.filter(F.coalesce(first, second, F.array().cast(RESULT)), lambda r: r["url"].rlike("^https?://"))


def html_results(body: Column) -> Column:
    """Links of a plain HTML result page: anchors of class result__a, their targets unwrapped."""
    pattern = r'(?is)<a[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    urls, titles = F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(urls.alias("u"), titles.alias("t"))
    inner = lambda u: F.when(u.contains("uddg="), F.url_decode(F.regexp_extract(u, "uddg=([^&]+)", 1))).otherwise(u)
    return F.transform(pairs, lambda p: F.struct(inner(p["u"]).alias("url"), F.trim(F.regexp_replace(p["t"], "<[^>]+>", "")).alias("title"), F.lit(None).cast("string").alias("snippet")))


def readme_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, folder, summary): rows of markdown tables whose first cell links to a
    folder here; links elsewhere are left out, and each folder counts once."""
    rows = docs.select(key, F.explode(F.split(text, r"\n")).alias("line")).where(F.col("line").rlike(r"^\s*\|.*\[.+\]\(.+\)"))
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    out = rows.select(key, F.regexp_extract("line", link, 1).alias("name"), F.regexp_replace(F.regexp_extract("line", link, 2), r"^\./|/$", "").alias("folder"), F.element_at(cells, -1).alias("summary"))
    return out.where(~F.col("folder").rlike("^(?:https?:|#)")).groupBy(key, "folder").agg(F.min(F.struct("name", "summary")).alias("r")).select(key, "r.name", "folder", "r.summary")


_FLOW = (
    "objects array<struct<id:string,instance:string,template:string,anchors:map<string,string>,latches:array<string>,source:string,target:string,"
    "properties:array<array<string>>>>"
)


def flow_edges(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, source, target): lines of an attack-flow file from node to node. A line ends
    in latches, latches hang on anchors, anchors belong to nodes: three joins."""
    o = files.select(key, F.explode(F.from_json(F.col(body), _FLOW)["objects"]).alias("o")).select(key, "o.*")
    anchors = o.where("anchors is not null").select(key, F.coalesce("id", "instance").alias("node"), F.explode(F.map_values("anchors")).alias("anchor"))
    latches = o.where("latches is not null").select(key, F.col("instance").alias("anchor"), F.explode("latches").alias("latch"))
    ends = latches.join(anchors, [key, "anchor"]).select(key, "latch", "node")
    lines = o.where("template = 'dynamic_line'").select(key, "source", "target")
    a = lines.join(ends.select(key, F.col("latch").alias("source"), F.col("node").alias("from_node")), [key, "source"])
    b = a.join(ends.select(key, F.col("latch").alias("target"), F.col("node").alias("to_node")), [key, "target"])
    return b.select(key, F.col("from_node").alias("source"), F.col("to_node").alias("target")).distinct()


def indicator_files(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, day, text): indicator text files with the day their path names; feed text to operators.extract.harvest()."""
    day = F.try_to_timestamp(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    return files.select(path, day.alias("day"), text)
