"""Rows out of pages and texts: readable text, indicators, sentences with labels, dates.

Each function parses one document inside a task; the tables around them are
ordinary DataFrames, and what is counted or matched is joined and grouped.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwork.functions.batches import pieces
from siftwork.session import ship

# Query parameters that don't change a page.
TRACKING = frozenset("fbclid gclid gclsrc dclid msclkid mc_cid mc_eid igshid ref ref_src ref_url source cmpid spm share print amp output".split())
_SKIP = frozenset("script style noscript svg template nav footer header aside form iframe button select".split())
_BLOCK = frozenset("p div section article main li ul ol table tr h1 h2 h3 h4 h5 h6 br pre blockquote dd dt figcaption".split())


def canonical_url(raw: str | None) -> str | None:
    """One address per page: no fragment, mobile host, default port, index file or
    tracking parameter; sorted parameters; AMP caches unwrapped. None if it is no web address."""
    try:
        u = urlsplit((raw or "").strip())
        port = u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not u.hostname:
        return None
    m = re.match(r"^/(?:[a-z]/)?(?:s/)?([^/]+\.[a-z]{2,}/.*)$", u.path)
    if u.hostname.endswith(".cdn.ampproject.org") and m:
        return canonical_url("https://" + m[1])
    host = re.sub(r"^(?:amp|m|mobile)\.(?=[^.]+\.)", "", u.hostname.lower())
    if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host += f":{port}"
    path = re.sub(r"/{2,}", "/", u.path or "/")
    path = re.sub(r"/(?:amp|print)/?$|/index\.(?:html?|php|aspx?)$", "/", path)
    path = path.rstrip("/") or "/"
    keep = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING and not k.lower().startswith("utm_"))
    return f"{u.scheme.lower()}://{host}{path}" + (f"?{urlencode(keep)}" if keep else "")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.titles: dict[str, str] = {}
        self.meta: dict[str, str] = {}
        self.links: list[list[str]] = []
        self.skip, self.inside = 0, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (k := a.get("property") or a.get("name")) and a.get("content"):
            self.meta.setdefault(k.lower(), a["content"])
        elif tag == "a" and a.get("href"):
            self.links.append([a["href"], ""])
        if tag in _SKIP:
            self.skip += 1
        elif tag in _BLOCK:
            self.parts.append("\n")
        if tag in ("title", "h1", "article"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK:
            self.parts.append("\n")
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if "h1" in self.inside:
            key = "article h1" if "article" in self.inside else "h1"
            self.titles[key] = self.titles.get(key, "") + data
        elif "title" in self.inside:
            self.titles["title"] = self.titles.get("title", "") + data
            return
        if self.links and data.strip():
            self.links[-1][1] = self.links[-1][1] or data.strip()[:200]
        if not self.skip:
            self.parts.append(data)


def page(html: str | None) -> dict:
    """Title, text, author, publisher, published and links of a page."""
    p = _Page()
    p.feed(html or "")
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    squeeze = lambda x: re.sub(r"\s+", " ", x or "").strip() or None
    title = p.titles.get("article h1") or p.meta.get("og:title") or p.titles.get("title") or p.titles.get("h1")
    return {
        "title": squeeze(title), "text": "\n".join(x for x in lines if x), "author": squeeze(p.meta.get("author") or p.meta.get("article:author")),
        "publisher": squeeze(p.meta.get("og:site_name")), "published": p.meta.get("article:published_time") or p.meta.get("date"), "links": [{"href": h, "label": t} for h, t in p.links],
    }


_PAGE = "struct<title:string,text:string,author:string,publisher:string,published:string,links:array<struct<href:string,label:string>>>"


def pages_to_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text, author, publisher, published, links)"""

    @F.pandas_udf(_PAGE)
    def parse(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(x) for x in col], columns=["title", "text", "author", "publisher", "published", "links"])

    return pages.select(key, parse(html).alias("p")).select(key, "p.*")


def canonical_urls(df: DataFrame, url: str, name: str = "canonical_url") -> DataFrame:
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(canonical_url)

    return df.withColumn(name, run(url))


def outlinks(parsed: DataFrame, key: str, base: str) -> DataFrame:
    """(key, url, label): links of parsed pages to other hosts, absolute, each once."""

    @F.pandas_udf("string")
    def absolute(href: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([canonical_url(urljoin(b or "", h)) for h, b in zip(href, at, strict=True)])

    one = parsed.select(key, base, F.explode("links").alias("l")).select(key, base, absolute("l.href", base).alias("url"), "l.label")
    host = lambda c: F.regexp_extract(c, r"^https?://([^/:?#]+)", 1)
    return one.where(F.col("url").isNotNull() & (host(F.col("url")) != host(F.col(base)))).groupBy(key, "url").agg(F.min("label").alias("label"))


# Indicators. Kinds are looked for in this order, and a span once taken stays taken.
_DOT = r"(?:\.|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?)"
_KINDS = [
    ("cve", re.compile(r"(?i)\bCVE-\d{4}-\d{4,7}\b")),
    ("technique", re.compile(r"\bT\d{4}(?:\.\d{3})?\b")),
    ("sha256", re.compile(r"\b[A-Fa-f0-9]{64}\b")),
    ("sha1", re.compile(r"\b[A-Fa-f0-9]{40}\b")),
    ("md5", re.compile(r"\b[A-Fa-f0-9]{32}\b")),
    ("url", re.compile(r"(?i)\bh(?:tt|xx)ps?(?:\[:\]|:)//[^\s\"'<>]+")),
    ("email", re.compile(rf"\b[\w.+-]+(?:@|\s?[\[({{]\s?(?:@|at)\s?[\])}}]\s?)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")),
    ("ipv4", re.compile(rf"(?<![\d.])\d{{1,3}}(?:{_DOT}\d{{1,3}}){{3}}(?![\d.]*\d)")),
    ("domain", re.compile(rf"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?{_DOT})+(?:com|net|org|io|info|biz|ru|cn|de|fr|es|uk|top|xyz|online|site|club|dev|app|co)\b")),
]
_ROLE = [("benign", re.compile(r"(?i)\b(?:legitimate|benign|trusted)\b")), ("c2", re.compile(r"(?i)\b(?:c2|c&c|command.and.control|beacon)\b")), ("delivery", re.compile(r"(?i)\b(?:download|phish|payload|dropper|hosted)\b"))]


def refang(s: str) -> str:
    s = re.sub(r"(?i)\bhxxp", "http", s)
    s = re.sub(r"(?i)\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?", ".", s)
    s = re.sub(r"(?i)\s?[\[({]\s?(?:@|at)\s?[\])}]\s?", "@", s)
    return s.replace("[:]", ":")


def public_ip(ip: str) -> bool:
    import ipaddress

    try:
        return ipaddress.IPv4Address(ip).is_global
    except ValueError:
        return False


def indicators(text: str | None) -> list[dict]:
    """kind, value, original, defanged, role, start and end; each kind and value once.
    Addresses that aren't public are left out. Offsets are code points."""
    text, taken, out, seen = text or "", [], [], set()
    for kind, pattern in _KINDS:
        for m in pattern.finditer(text):
            s, e = m.span()
            raw = m[0].rstrip(".,;:)]}") if kind == "url" else m[0]
            e = s + len(raw)
            if any(s < b and a < e for a, b in taken):
                continue
            value = refang(raw)
            if kind == "ipv4" and not public_ip(value):
                continue
            value = value.upper() if kind in ("cve", "technique") else value if kind == "url" else value.lower()
            taken.append((s, e))
            if (kind, value) not in seen:
                seen.add((kind, value))
                around = text[max(0, text.rfind(".", 0, s)) : e + 80]
                role = next((r for r, p in _ROLE if p.search(around)), "indicator")
                out.append({"kind": kind, "value": value, "original": raw, "defanged": raw != value and refang(raw) != raw, "role": role, "start": s, "end": e})
    return out


_IOC = "array<struct<kind:string,value:string,original:string,defanged:boolean,role:string,start:int,end:int>>"


def harvest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    @F.pandas_udf(_IOC)
    def run(col: pd.Series) -> pd.Series:
        return col.map(indicators)

    return docs.select(key, F.explode(run(text)).alias("i")).select(key, "i.*")


_LINK = r"\[([^\]]*)\]\((?:[^()\s]|\([^()\s]*\))+\)"


def article_prose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, prose): a text's lines without those that are links only and without
    repeats (in any case); links in other lines show their words. Lines are rows,
    put in order again by their numbers: nothing loops over a text. Keys are distinct."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line"))
    rows = rows.select(key, "n", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("line")).where("line <> ''")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", _LINK, ""), r"^(?:[-*•]|\d{1,3}[.)])\s*", ""), r"[\s|·,;:•–—-]+", "")
    rows = rows.where(~(F.col("line").rlike(_LINK) & (F.length(bare) <= 3)))
    shown = rows.select(key, "n", F.regexp_replace("line", _LINK, "$1").alias("line")).withColumn("low", F.xxhash64(F.lower("line")))
    first = shown.groupBy(key, "low").agg(F.min_by("line", "n").alias("line"), F.min("n").alias("n"))
    kept = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("prose"))
    return docs.select(key).join(kept, key, "left").select(key, F.coalesce("prose", F.lit("")).alias("prose"))


# What stands before a point that ends no sentence, and list marks before a piece.
_ABBREVIATION = re.compile(r"(?i)(?:^|[\s(])(?:e\.g|i\.e|etc|vs|inc|ltd|corp|co|no|nos|fig|figs|mr|mrs|ms|dr|st|approx|al|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec|u\.s|u\.k|[a-z])$")
_MARK = re.compile(r"(?:[\s\u00a0]|[•·▪●◦‣■□►▶✓✔]|[-*–—+](?=\s)|\(?\d{1,2}[.)](?=\s)|\(?[a-z][.)](?=\s))+")
_SOLID = re.compile("[A-Za-z0-9]")
_CUT = re.compile("(?P<stop>[.!?]+[\"'”’)\\]]*)(?=[^\\S\\n\\r]+[\"'“‘(\\[]?[A-Z0-9•])|[^\\S\\n\\r](?=[•▪●◦‣][^\\S\\n\\r])|[\\n\\r]+")


def _spans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in [*_CUT.finditer(text), None]:
        end = len(text) if m is None else m.end() if m["stop"] else m.start()
        if m and m["stop"] == "." and _ABBREVIATION.search(text[max(at, m.start() - 12) : m.start()]):
            continue
        piece = text[at:end]
        mark = _MARK.match(piece)
        s, e = at + (mark.end() if mark else 0), at + len(piece.rstrip())
        if e - s >= 2 and _SOLID.search(text, s, e):
            yield s, e
        at = end


def sentences(text: str | None) -> list[dict]:
    """start, end and sentence, exact slices, and before: what stands between it and
    the one before (null for the first). Line ends, list marks inside a line, and
    points before a capital end a sentence; abbreviations don't."""
    text, out = text or "", []
    for s, e in _spans(text):
        out.append({"start": s, "end": e, "sentence": text[s:e], "before": text[out[-1]["end"] : s] if out else None})
    return out


def _said(texts: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Of every sentence of texts: the row it comes from, then its number among the row's, and what sentences() tells."""
    of, n, start, end, said, before = array("i"), array("i"), array("i"), array("i"), [], []
    for i, text in enumerate(texts.to_pylist()):
        last = None
        for k, (s, e) in enumerate(_spans(text or "")):
            of.append(i)
            n.append(k)
            start.append(s)
            end.append(e)
            said.append(text[s:e])
            before.append(None if last is None else text[last:s])
            last = e
    ints = [pa.array(np.frombuffer(x, np.int32)) if len(x) else pa.array([], pa.int32()) for x in (of, n, start, end)]
    return ints[0], [*ints[1:], pa.array(said, pa.string()), pa.array(before, pa.string())]


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, start, end, sentence, before): a row a sentence, as sentences() tells them."""
    ship(docs.sparkSession)
    rows = docs.select(key, text)
    schema = StructType([rows.schema[0]]).add("n", "integer").add("start", "integer").add("end", "integer").add("sentence", "string").add("before", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in pieces(b.column(1)):
                of, told = _said(b.column(1)[at:to])
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].take(of), *told], schema.names)

    return rows.mapInArrow(run, schema)


def technique_evidence(labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, technique, label, confidence, mentions, first_at): technique ids in labelled
    sentences; the strongest label wins; .85 and .03 more a mention, .95 at most."""
    one = labelled.select(key, "start", "label", F.explode(F.regexp_extract_all("sentence", F.lit(r"\b(T\d{4}(?:\.\d{3})?)\b"), F.lit(1))).alias("technique"))
    rank = F.when(F.col("label") == "observed", 2).when(F.col("label") == "hypothetical", 1).otherwise(0)
    g = one.where(rank > 0).groupBy(key, "technique").agg(F.max_by("label", rank).alias("label"), F.count("*").alias("mentions"), F.min("start").alias("first_at"))
    return g.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.85 + 0.03 * (F.col("mentions") - 1)), 2))


def chain(evidence: DataFrame, tactics: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, step, tactic, techniques): tactics by where their first technique stands. tactics: (technique, tactic)."""
    j = evidence.where("label = 'observed'").join(tactics, "technique")
    g = j.groupBy(key, "tactic").agg(F.min("first_at").alias("at"), F.array_sort(F.collect_set("technique")).alias("techniques"))
    return g.withColumn("step", F.row_number().over(W.partitionBy(key).orderBy("at", "tactic"))).select(key, "step", "tactic", "techniques")


def name_mentions(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id, alias, n): names of entities in texts, as an equi-join on a name's first
    word, then a bounded search; single words must have the name's case. Longer aliases
    come first, and what one has matched no shorter one can match. names: (id, alias)."""
    first = lambda c: F.lower(F.regexp_extract(c, r"^([\p{L}\p{N}]+)", 1))
    side = names.select("id", "alias", first(F.col("alias")).alias("w")).where("w <> ''")
    words = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    quoted = F.regexp_replace("alias", r"([.?+*()\[\]{}|\\^$-])", r"\\$1")
    bound = F.concat(F.when(F.col("alias").contains(" "), "(?i)").otherwise(""), F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))
    maybe = words.join(side, "w").select(key, F.struct((-F.length("alias")).alias("size"), "alias", "id", bound.alias("bound")).alias("c"))
    tried = maybe.groupBy(key).agg(F.array_sort(F.collect_set("c")).alias("cs"))  # bounded by a text's words

    def step(so_far: Column, c: Column) -> Column:
        hit = F.struct(c["id"].alias("id"), c["alias"].alias("alias"), F.regexp_count(so_far["left"], c["bound"]).alias("n"))
        return F.struct(F.regexp_replace(so_far["left"], c["bound"], chr(1)).alias("left"), F.concat(so_far["hits"], F.array(hit)).alias("hits"))

    none = F.array().cast("array<struct<id:string,alias:string,n:int>>")
    found = tried.join(docs.select(key, text), key).select(key, F.aggregate("cs", F.struct(F.col(text).alias("left"), none.alias("hits")), step)["hits"].alias("hits"))
    return found.select(key, F.explode("hits").alias("h")).where("h.n > 0").select(key, "h.id", "h.alias", "h.n")


def publication_day(candidates: list[tuple[str, Column]], now: str) -> Column:
    """The first plausible date of candidates (source, text), best source first:
    struct(day, source). Dates before 1995 or after now aren't plausible."""
    found = F.lit(None).cast("struct<day:date,source:string>")
    for source, c in reversed(candidates):
        day = normal_date(c)
        ok = day.isNotNull() & (day >= F.lit("1995-01-01").cast("date")) & (day <= F.lit(now).cast("date"))
        found = F.when(ok, F.struct(day.alias("day"), F.lit(source).alias("source"))).otherwise(found)
    return found


def normal_date(c: Column) -> Column:
    """ISO, month-name and slashed dates; null for anything else."""
    c = F.trim(c)
    iso = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    rfc = F.regexp_extract(c, r"(\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)) ?[a-z]* (\d{4})", 0)
    us = F.regexp_extract(c, r"^(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}", 0)
    at = lambda x, f: F.try_to_timestamp(F.nullif(x, F.lit("")), F.lit(f)).cast("date")
    return F.coalesce(at(iso, "yyyy-MM-dd"), at(rfc, "d MMM yyyy"), at(us, "MMMM d, yyyy"), at(F.regexp_extract(c, r"^\d{4}/\d{2}/\d{2}", 0), "yyyy/MM/dd"))


def plain(text: str) -> str:
    return unescape(re.sub(r"<[^>]+>", " ", text))
