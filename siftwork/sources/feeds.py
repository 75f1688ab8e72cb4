"""Feeds, sitemaps, robots files and outlinks: fetched documents in, rows out.

Each reader takes a table with a key and the fetched text and gives one row per
entry; the parsing of one document is a small function inside the task.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<[^>]+>")


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower()


def _parse(xml: str | None) -> ET.Element | None:
    """Root of a document without a DOCTYPE (no entities are expanded); None if it is broken."""
    if not xml or "<!DOCTYPE" in xml[:2000].upper() or "<!ENTITY" in xml.upper():
        return None
    try:
        return ET.fromstring(xml.strip().encode())
    except ET.ParseError:
        return None


def _text(e: ET.Element, *names: str) -> str | None:
    for n in names:
        for c in e:
            if _name(c) == n and (c.text or "").strip():
                return unescape(_TAG.sub(" ", c.text)).strip()
    return None


def feed_entries(xml: str | None) -> list[dict]:
    """RSS items, or Atom entries if there are none; only http links that aren't feeds themselves."""
    root = _parse(xml)
    if root is None:
        return []
    items = [e for e in root.iter() if _name(e) == "item"] or [e for e in root.iter() if _name(e) == "entry"]
    out = []
    for e in items:
        link = _text(e, "link", "guid")
        if not link:
            links = [c for c in e if _name(c) == "link"]
            best = next((c for c in links if c.get("rel", "alternate") == "alternate"), None)
            link = best.get("href") if best is not None else None
        if link and re.match(r"https?://", link) and not re.search(r"(?i)\.(?:xml|rss|atom|png|jpe?g|gif|css|js)(?:$|\?)", link):
            out.append({"url": link.strip(), "title": _text(e, "title"), "summary": _text(e, "description", "summary", "content"), "published": _text(e, "pubdate", "published", "updated", "date")})
    return out


def sitemap_entries(xml: str | None, most: int = 50_000) -> list[dict]:
    """Locations of a sitemap or an index, each once; most is the format's own limit."""
    root = _parse(xml)
    seen: dict[str, dict] = {}
    for e in () if root is None else root:
        loc = _text(e, "loc")
        if loc and loc not in seen and len(seen) < most:
            seen[loc] = {"loc": loc, "lastmod": _text(e, "lastmod"), "index": _name(root) == "sitemapindex"}
    return list(seen.values())


def robots_rules(text: str | None, agent: str = "*") -> list[dict]:
    """allow and disallow rules of the groups that name the agent, else of *."""
    groups: dict[str, list[dict]] = {}
    names, open_ = [], True
    for line in (text or "").splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if value:
                for n in names:
                    groups.setdefault(n, []).append({"allow": key == "allow", "path": value})
    return groups.get(agent.lower(), groups.get("*", []))


def _table(schema: str, parse):
    @F.pandas_udf(schema)
    def run(col: pd.Series) -> pd.Series:
        return col.map(parse)

    return run


def read_feeds(fetched: DataFrame, key: str, xml: str) -> DataFrame:
    parse = _table("array<struct<url:string,title:string,summary:string,published:string>>", feed_entries)
    return fetched.select(key, F.explode(parse(xml)).alias("e")).select(key, "e.*")


def read_sitemaps(fetched: DataFrame, key: str, xml: str) -> DataFrame:
    parse = _table("array<struct<loc:string,lastmod:string,index:boolean>>", sitemap_entries)
    return fetched.select(key, F.explode(parse(xml)).alias("e")).select(key, "e.*").dropDuplicates([key, "loc"])


def sitemap_window(entries: DataFrame, since: str | None, until: str | None, keep_undated: bool = False) -> DataFrame:
    """since counts, until doesn't; undated entries only if asked for."""
    day = F.substring("lastmod", 1, 10)
    ok = F.lit(True)
    if since:
        ok &= day >= since
    if until:
        ok &= day < until
    return entries.where(F.when(F.col("lastmod").isNull(), F.lit(keep_undated)).otherwise(ok))


def rank_child_sitemaps(entries: DataFrame, since: str | None, limit: int) -> DataFrame:
    """Child sitemaps that look like articles first; taxonomies and old ones last or out."""
    loc = F.lower("loc")
    score = (
        F.when(loc.rlike("post|article|news|blog|research|report"), 2).otherwise(0)
        - F.when(loc.rlike("tag|categor|author|taxonom|image|video|page-sitemap"), 3).otherwise(0)
        - F.when(F.substring("lastmod", 1, 10) < F.lit(since or ""), 99).otherwise(0)
    )
    return entries.withColumn("score", score).where("score > -5").orderBy(F.desc("score"), F.desc_nulls_last("lastmod"), "loc").limit(limit)


def read_robots(fetched: DataFrame, key: str, text: str, agent: str = "*") -> DataFrame:
    parse = _table("array<struct<allow:boolean,path:string>>", lambda t: robots_rules(t, agent))
    return fetched.select(key, F.explode(parse(text)).alias("e")).select(key, "e.*")


def robots_pattern(path: Column) -> Column:
    """A rule's path as a regular expression: * is anything, a last $ the end."""
    quoted = F.regexp_replace(path, r"([.?+()\[\]{}|\\^])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\$"))


def robots_allowed(urls: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """urls with allowed: the longest rule of their host that matches decides, allow
    wins ties, and nothing matching allows. rules: (host, allow, path)."""
    r = rules.select(F.col(host).alias("_h"), "allow", F.col("path").alias("_p"))
    hit = urls.select(host, path).distinct().join(r, F.col(host) == F.col("_h")).where(F.regexp_like(F.col(path), robots_pattern(F.col("_p"))))
    best = hit.groupBy(host, path).agg(F.max_by("allow", F.struct(F.length("_p").alias("n"), F.col("allow"))).alias("_a"))
    return urls.join(best, [host, path], "left").withColumn("allowed", F.coalesce("_a", F.lit(True))).drop("_a")


def feed_links(html: str | None) -> list[str]:
    """Feed addresses a page declares, alternates first, comment feeds left out."""
    out = []
    for tag in re.findall(r"(?is)<(?:link|a)\b[^>]*>", html or ""):
        href = re.search(r"""(?i)\bhref\s*=\s*["']([^"']+)""", tag)
        if href and "comment" not in href[1].lower():
            alternate = re.search(r"(?i)rel\s*=\s*[\"']?alternate", tag) and re.search(r"(?i)type\s*=\s*[\"']?application/(?:rss|atom)", tag)
            if alternate:
                out.append((0, len(out), href[1]))
            elif re.search(r"(?i)(?:/feed/?|/rss/?|\.rss|atom\.xml|rss\.xml)$", href[1]):
                out.append((1, len(out), href[1]))
    return list(dict.fromkeys(x[2] for x in sorted(out)))


def discover_feeds(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, url): the feeds that pages declare, best first."""
    parse = _table("array<string>", feed_links)
    return pages.select(key, F.posexplode(parse(html)).alias("n", "url"))


def page_urls(pattern: Column, first: Column, last: Column) -> Column:
    """Addresses of a numbered series: {page} in the pattern runs from first to last."""
    return F.transform(F.sequence(first, last), lambda i: F.replace(pattern, F.lit("{page}"), i.cast("string")))
