"""Text functions as Column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches skip, and words that can't carry a match alone.
STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her "
    "here hers him his how i if in into is it its itself just me more most my no nor not of off on once only or "
    "other our ours out over own same she should so some such than that the their theirs them then there these "
    "they this those through to too under until up very was we were what when where which while who whom why "
    "will with would you your yours about above after again against all am any because before below between "
    "both down during each few further s t also may might must shall us via per within without upon onto "
    "tell show give list find please know explain describe summarize summarise anything something "
    "get got let lets let's"
).split()
LOW_SIGNAL = (
    "threat threats intel intelligence report reports advisory advisories security cyber cybersecurity attack "
    "attacks attacker attackers actor actors latest recent new info information data system systems platform "
    "library evidence analysis activity activities campaign campaigns related regarding known used use using "
    "observed seen documents document source sources"
).split()
CVE, TECHNIQUE, DIGEST, IPV4 = r"cve-\d{4}-\d{4,7}", r"t\d{4}(?:\.\d{3})?", r"(?:[a-f0-9]{32}|[a-f0-9]{40}|[a-f0-9]{64})", r"\d{1,3}(?:\.\d{1,3}){3}"
EXACT_ID = f"^(?:{CVE}|{TECHNIQUE}|{DIGEST}|{IPV4})$"
RUN = r"[a-z0-9]+(?:[-._][a-z0-9]+)*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda inside body that named the
    expression itself would compute it again for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, for negative numbers too (unlike round())."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def is_exact_id(token: Column) -> Column:
    return token.rlike(EXACT_ID)


def is_low_signal(token: Column) -> Column:
    return token.isin(LOW_SIGNAL)


def term_weight(token: Column) -> Column:
    return F.when(is_exact_id(token), 3.0).when(is_low_signal(token), 0.3).otherwise(1.0)


def tokens(text: Column) -> Column:
    """Search tokens in order: identifiers whole (a sub-technique with its parent
    too), joined names whole and in parts, other runs of two characters or a
    digit, without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])

    def of(raw: Column) -> Column:
        parts = F.filter(F.split(raw, "[-._]"), lambda p: (F.length(p) >= 2) & ~F.array_contains(stop, p))
        cve = F.regexp_extract(raw, f"^({CVE})", 1)
        whole = F.when(cve != "", cve).otherwise(raw)
        parent = raw.rlike(r"^t\d{4}\.\d{3}$")
        plain = ((F.length(raw) >= 2) | raw.rlike(r"\d")) & ~F.array_contains(stop, raw)
        return (
            F.when(parent, F.array(raw, F.substring(raw, 1, 5)))
            .when(is_exact_id(raw), F.array(raw))
            .when(raw.rlike("[-._]"), F.concat(F.array(whole), parts))
            .when(plain, F.array(raw))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0)), of))


def plain_runs(text: Column) -> Column:
    """Runs of letters and digits, lower case: the part of tokens() that SQL engines share."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def exact_ids(text: Column, pattern: str) -> Column:
    """Distinct identifiers of a text, upper case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({pattern})\b"), F.lit(1)), F.upper))


def refang(text: Column) -> Column:
    """Indicators as they were: hxxp, [.], (dot), [at] and the like undone."""
    out = F.regexp_replace(text, r"(?i)\bhxxp(s?)", "http$1")
    out = F.regexp_replace(out, r"(?i)\s*[\[({]\s*(?:\.|dot)\s*[\])}]\s*", ".")
    out = F.regexp_replace(out, r"(?i)\s*[\[({]\s*(?:@|at)\s*[\])}]\s*", "@")
    out = F.regexp_replace(out, r"[\[({]:[\])}]", ":")
    return F.regexp_replace(out, r"[\[({]//[\])}]", "//")


def flatten_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")


def excerpt(text: Column, n: int = 220) -> Column:
    """Plain text squeezed to one line, cut at n with an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " ")
    t = F.trim(F.regexp_replace(F.when(text.rlike(r"(?i)<[a-z!/][^>]*>"), t).otherwise(text), r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit(chr(0x2026)))).otherwise(t)


def slug(text: Column, n: int = 80) -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, n)


def title_from_slug(url: Column) -> Column:
    """A readable title from the last path segment that isn't a number."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(r"^\d+$"))
    last = F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), parts), -1), r"\.[a-z]{2,5}$", "")
    words = F.trim(F.regexp_replace(last, "[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def stem(word: Column) -> Column:
    """Light stemming: plural, -ing and -ed endings of long enough words."""
    return (
        F.when(word.rlike("^.{3,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("^.{4,}(?:ing)$"), F.regexp_replace(word, "ing$", ""))
        .when(word.rlike("^.{3,}(?:ed)$"), F.regexp_replace(word, "ed$", ""))
        .when(word.rlike("^.{3,}(?:ss|us|is)$"), word)
        .when(word.rlike("^.{3,}s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def normal_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", " "))


def is_public_ipv4(ip: Column) -> Column:
    """False for private, loopback, link-local, shared, documentation, multicast and reserved ranges."""
    p = F.transform(F.split(ip, r"\."), lambda x: x.cast("int"))
    a, b, c = p[0], p[1], p[2]
    inner = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    valid = (F.size(p) == 4) & ~F.exists(p, lambda x: x.isNull() | (x > 255))
    return valid & ~inner


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a country's second level."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    second = F.regexp_like(two, F.lit(r"^(?:co|com|net|org|gov|edu|ac)\.[a-z]{2}$"))
    return F.when((n >= 3) & second, three).otherwise(two)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def word_shingles(text: Column, k: int = 5, words: int | None = None) -> Column:
    """Distinct hashes of k words in a row."""
    w = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " "), r"\s+"), lambda x: x != "")
    if words:
        w = F.slice(w, 1, words)
    none = F.array().cast("array<bigint>")

    def runs(v: Column) -> Column:
        n = F.size(v) - k + 1
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(v, i, k), " "))))).otherwise(none)

    return let(w, runs)
