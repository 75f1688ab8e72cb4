"""Personal data by weak supervision over candidate spans.

Exact patterns (email, ip, card, phone) give base spans that always stay.
Beyond them, loose candidates (secret strings, long numbers, person names) are
voted on by three labelers: a pattern, a gazetteer and the words around. No
labeler is trusted: expectation-maximisation over the counts of all vote
patterns in the corpus estimates how often each is right. The votes so
weighted label the candidates from which a logistic span classifier learns
their outward features; its spans are added to the base ones.

Everything that is gathered is a count by votes and features, of which there
are a fixed number; all texts count.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.textbatch import blocks
from siftwork.session import ship

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name")

# The base patterns, written so that long runs are read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}+=?=?")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){7,18}(?![0-9A-Za-z])")
_NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-z]{2,15} [A-Z][a-z]{2,15}(?![A-Za-z])")

# What the gazetteer and the context labelers know.
GIVEN = frozenset("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Laura Hans Klaus Jürgen Pierre Marie Jean Luc Carlos Maria Juan Luisa".split())
KEYS = frozenset("token secret password passwd apikey api_key key auth bearer access_token pwd".split())
ID_WORDS = frozenset("ssn passport iban account konto cuenta compte id nr no number tax steuer dni".split())
AROUND = {
    "secret": re.compile(r"[=:]\s*[\"']?$"),
    "number": re.compile(r"(?i)(?:\b(?:call|phone|tel|mobile|account|card|id|no|nr|number)\b\W*|[#=:]\s*)$"),
    "name": re.compile(r"(?i)\b(?:mr|mrs|ms|dr|prof|herr|frau|m|mme|sr|sra|name|contact|dear|signed|by)\b\W*$"),
}
_LAST_WORD = re.compile(r"([A-Za-z_]+)\W*$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that hold its condition."""
    out, pos = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes, features) of spans that no base span touches.

    votes: three digits in base 3 (0 against, 1 no opinion, 2 for); features: bits.
    """
    taken = sorted((s, e) for _, s, e in base)
    found = [("secret", m) for m in _SECRET.finditer(text)]
    found += [("number", m) for m in _NUMBER.finditer(text)]
    found += [("name", m) for m in _NAME.finditer(text)]
    starts = np.array([s for s, _ in taken])
    # Kinds don't overlap here, but a card may hold an ip: the reach so far decides.
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else starts
    for kind, m in found:
        s, e = m.span()
        i = int(np.searchsorted(starts, e))
        if i and reach[i - 1] > s:
            continue
        x, before, after = m[0], text[max(0, s - 40) : s], text[e : e + 1]
        last = _LAST_WORD.search(before)
        word = last[1].lower() if last else ""
        digits = sum(c.isdigit() for c in x)
        hexa = all(c in "0123456789abcdefABCDEF" for c in x)
        if kind == "secret":
            form = 2 if hexa and len(x) in (32, 40, 64) or (digits > 3 and x.lower() != x != x.upper()) else 0 if "/" in x or digits < 3 else 1
            known = 2 if word in KEYS else 1
        elif kind == "number":
            form = 2 if _luhn("".join(c for c in x if c.isdigit())) and digits >= 12 else 0 if x.isdigit() and len(set(x)) < 4 else 1
            known = 2 if word in ID_WORDS else 1
        else:
            form = 1 if x[-1] in "aeiounrsty" else 0
            known = 2 if x.split()[0] in GIVEN else 0
        near = 2 if AROUND[kind].search(before) else 0
        features = (len(x) >= 24) | (len(x) >= 36) << 1 | (digits * 2 > len(x)) << 2 | hexa << 3 | (before[-1:] in ("'", '"') and after in ("'", '"') and before != "") << 4 | (before[-1:] in ("=", ":", "#")) << 5 | (x.isalnum()) << 6 | (before.rstrip().endswith((".", "!", "?")) or not before.strip()) << 7
        yield kind, s, e, form * 9 + known * 3 + near, features


FEATURES, PATTERNS = 8, 27


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update((c[0], c[3], c[4]) for c in candidates(text, base_spans(text)))
    kind, votes, features = zip(*seen, strict=True) if seen else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(votes, pa.int32()), pa.array(features, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "features", "n"])


def reliabilities(n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of 'personal' for each of the 27 vote patterns, by expectation-
    maximisation over their counts n: a prior, and for each labeler the chances of
    its three votes in either class. It starts from labelers right 7 times in 10."""
    votes = np.array([[p // 9, p // 3 % 3, p % 3] for p in range(PATTERNS)])
    like = np.tile(np.array([[0.7, 1.0, 0.3], [0.3, 1.0, 0.7]])[:, None, :], (1, 3, 1))  # class, labeler, vote
    prior = 0.5
    post = np.full(PATTERNS, prior)
    for _ in range(rounds):
        log = [np.log(like[c][np.arange(3), votes]).sum(axis=1) for c in (0, 1)]
        post = 1 / (1 + (1 - prior) / prior * np.exp(np.clip(log[0] - log[1], -50, 50)))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(3):
                # Two imagined votes of each sort keep rare ones from becoming certain, and labelers better than chance.
                lean = np.array([1.4, 1.0, 0.6]) if c == 0 else np.array([0.6, 1.0, 1.4])
                like[c, j] = np.bincount(votes[:, j], w, 3) + 2 * lean
                like[c, j] /= like[c, j].sum()
        prior = np.clip((n * post).sum() / max(n.sum(), 1), 0.02, 0.98)
    return post


class SpanClassifier:
    """Logistic regression on a candidate's features and votes, one per kind."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.post, self.weights = {}, {}
        for kind in ADDED:
            own = [(v, f, n) for k, v, f, n in rows if k == kind]
            n = np.zeros(PATTERNS)
            for v, _, m in own:
                n[v] += m
            self.post[kind] = reliabilities(n)
            if not own:
                self.weights[kind] = np.append(np.zeros(FEATURES + 3), -5.0)
                continue
            x = np.array([self.inputs(v, f) for v, f, _ in own])
            y, m = np.array([self.post[kind][v] for v, _, _ in own]), np.array([m for *_, m in own], float)
            m /= m.sum()
            w = np.zeros(x.shape[1])
            for _ in range(400):
                w -= 2 * (x.T @ (m * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
            self.weights[kind] = w

    @staticmethod
    def inputs(votes: int, features: int) -> list[float]:
        return [float(features >> i & 1) for i in range(FEATURES)] + [votes // 9 - 1.0, votes // 3 % 3 - 1.0, votes % 3 - 1.0, 1.0]

    def table(self) -> dict[str, np.ndarray]:
        """Whether a candidate is personal, by votes and features."""
        x = np.array([[self.inputs(v, f) for f in range(1 << FEATURES)] for v in range(PATTERNS)])
        return {k: x @ w > 0 for k, w in self.weights.items()}


def learn(texts: DataFrame) -> dict[str, np.ndarray]:
    rows = texts.mapInArrow(_counted, "kind string, votes int, features int, n bigint").groupBy("kind", "votes", "features").agg(F.sum("n"))
    # At most 3 kinds * 27 patterns * 256 features.
    return SpanClassifier([tuple(r) for r in rows.collect()]).table()


def all_spans(text: str, table: dict[str, np.ndarray]) -> tuple[list, list]:
    base = base_spans(text)
    more = [(k, s, e) for k, s, e, v, f in candidates(text, base) if table[k][v, f]]
    return base, more


def _found(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    table = sent.value
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for batch in batches:
        for part in blocks(batch, "text"):
            out = []
            for text in part.column("text").to_pylist():
                base, more = all_spans(text or "", table)
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (kind:start:end, code points, end exclusive; base
    kinds first, then secret, number and name). Null texts count as empty;
    repeated rows are counted and answered each; nothing else is read."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast(learn(rows.select("text")))
    return rows.mapInArrow(
        lambda it: _found(it, sent),
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )


def masked(text: str, table: dict[str, np.ndarray]) -> str:
    """text with every span (overlapping ones together) replaced by its kind."""
    base, more = all_spans(text, table)
    out, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in base + more):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, -e)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """documents with personal data masked in text, and n_chars of what is left."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(learn(docs.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = [None if t is None else masked(t, table) for t in part.column("text").to_pylist()]
                names = part.schema.names
                part = part.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
                if "n_chars" in names:
                    n = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                    part = part.set_column(names.index("n_chars"), "n_chars", n.cast(part.schema.field("n_chars").type))
                yield part

    return docs.mapInArrow(run, docs.schema)
