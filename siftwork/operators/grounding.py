"""What a written analysis says, held against the text that it is about.

A text is normalised with a map back, so a quote that is found in the normalised
text is returned with its exact place in the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T

# Characters that count as one another, marks that count as nothing, and what a summary may not make up.
SAME = {**dict.fromkeys("‘’‚‛′", "'"), **dict.fromkeys("“”„″", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), "\u00a0": " "}
MARKS = frozenset("*_`")
ARTIFACTS = [r"(?i)\bCVE-\d{4}-\d{4,7}\b", r"\bT\d{4}(?:\.\d{3})?\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?i)\b[a-f0-9]{32,64}\b"]
#: Letters of a quote and of a clause of it that are enough to be looked for.
LEAST_QUOTE, LEAST_CLAUSE = 12, 40

_DEFANGED = re.compile(r"\bhxxp(?=s?\b)|\s*[\[({]\s*(?:\.|dot)\s*[\])}]\s*|\s*[\[({]\s*(?:@|at)\s*[\])}]\s*|[\[({]:[\])}]|[\[({]//[\])}]", re.IGNORECASE)
_ENDS = re.compile("^[\"'“”]+|[\"'“”.]+$")
_CLAUSE = re.compile(r"(?<=[.;:!?])\s+|\s+[-–—]\s+")


def _undone(found: str) -> str:
    low = found.lower()
    if "xxp" in low:
        return "http"
    bare = low.strip(" \t\r\n[](){}")
    return {"dot": ".", "at": "@"}.get(bare, bare or ".")


def normalised(text: str) -> tuple[str, list[int]]:
    """The text as it is compared (identifiers as they were, lower case, plain quotes
    and dashes, no marks, single blanks), and of each of its letters the place in text,
    with one place more for the end."""
    out: list[str] = []
    back: list[int] = []

    def put(piece: str, at: int) -> None:
        for c in piece:
            c = SAME.get(c, c)
            if c in MARKS or (c.isspace() and (not out or out[-1] == " ")):
                continue
            for x in " " if c.isspace() else c.lower():
                out.append(x)
                back.append(at)

    at = 0
    for m in _DEFANGED.finditer(text):
        for i in range(at, m.start()):
            put(text[i], i)
        put(_undone(m[0]), m.start())
        at = m.end()
    for i in range(at, len(text)):
        put(text[i], i)
    while out and out[-1] == " ":
        out.pop()
        back.pop()
    end = back[-1] + 1 if back else 0
    # A form that was undone is one place long: its end is where the next letter begins.
    ends = [m.end() for m in _DEFANGED.finditer(text) if back and m.start() == back[-1]]
    return "".join(out), [*back, max([end, *ends])]


def place(whole: str, back: list[int], quote: str) -> tuple[str, int, int] | None:
    """The quote, or the first of its long clauses, that stands in a normalised text:
    (what was found, start, end) with places in the original."""
    q = re.sub(r"\s+", " ", quote).strip()
    if len(q) < LEAST_QUOTE:
        return None
    tries = [(q, _ENDS.sub("", q))] + [(c, c) for c in (_ENDS.sub("", c) for c in _CLAUSE.split(q)) if len(c) >= LEAST_CLAUSE]
    for said, bare in tries:
        p = normalised(bare)[0]
        at = whole.find(p) if len(p) >= 2 else -1
        if at >= 0:
            return said, back[at], max(back[at] + 1, back[at + len(p)] if at + len(p) < len(whole) else back[-1])
    return None


def ground_quotes(texts: DataFrame, quotes: DataFrame, key: str = "doc_id", text: str = "text", quote: str = "quote", n: str = "n") -> DataFrame:
    """(key, n, found, start, end) of quotes that their text has; the others are left
    out. A text is normalised once for all its quotes. quotes: (key, n, quote), a
    bounded number a key."""
    asked = quotes.groupBy(key).agg(F.collect_list(F.struct(F.col(n).cast("bigint").alias("n"), F.col(quote).alias("quote"))).alias("asked"))
    rows = texts.select(key, F.col(text).alias("text")).join(asked, key)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, whole, wanted in zip(pdf[key], pdf["text"], pdf["asked"]):
                flat, back = normalised(whole or "")
                for q in wanted:
                    hit = place(flat, back, q["quote"] or "")
                    if hit:
                        out.append((k, q["n"], *hit))
            yield pd.DataFrame(out, columns=[key, "n", "found", "start", "end"])

    return rows.mapInPandas(run, f"{key} {kind}, n bigint, found string, start int, end int").withColumnRenamed("n", n)


def flat_text(c: Column) -> Column:
    """normalised() as an expression, for tests of containment."""
    out = F.lower(T.refang(F.coalesce(c, F.lit(""))))
    out = F.translate(out, "‘’‚‛′“”„″‐‑‒–—―−\u00a0*_`", "'''''" + '""""' + "-------" + " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def ground_summary(summary: Column, text: Column) -> Column:
    """struct(text, removed): a summary without the sentences that name an identifier,
    address or digest that the text doesn't, and how many these were."""
    flat = flat_text(text)
    said = F.filter(F.split(F.coalesce(summary, F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")

    def cited(s: Column) -> Column:
        return F.flatten(F.array(*[F.regexp_extract_all(s, F.lit(p), F.lit(0)) for p in ARTIFACTS]))

    kept = T.let(flat, lambda f: F.filter(said, lambda s: F.forall(cited(s), lambda a: f.contains(F.lower(a)))))
    return F.struct(F.array_join(kept, " ").alias("text"), (F.size(said) - F.size(kept)).alias("removed"))


def ground_values(values: DataFrame, texts: DataFrame, key: str = "doc_id", value: str = "value", text: str = "text") -> DataFrame:
    """The rows of values (key, value, ...) whose value, of two letters or more, stands in their text."""
    t = texts.select(key, flat_text(F.col(text)).alias("_flat"))
    v = values.withColumn("_v", flat_text(F.col(value))).where(F.length("_v") >= 2)
    return v.join(t, key).where(F.col("_flat").contains(F.col("_v"))).select(values.columns)
