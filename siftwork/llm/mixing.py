"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed into cells (one per combination of margin values); the
raking rounds are Spark jobs over cells only, the same at every size. Each round
scales the weights so that one margin after the other meets its target shares,
until no share is off by more than TOLERANCE. Documents are then sampled with
calibrated probabilities: min(1, scale * weight of their cell), where scale makes
the expected tokens equal the budget. A document's draw is a hash of its id and
text and a seed: it repeats, and doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.session import forget, stored

#: Largest error of a margin's share. Margins may contradict each other: then some cells fall towards nothing and
#: all others settle, so raking ends once no cell's weight gains more than STILL in a round. An error that stays the
#: same says nothing: where cells are nearly separate, small ones grow for many rounds before they tell.
#: MOST_ROUNDS is for margins that are met ever more slowly; the error left is reported.
TOLERANCE, STILL, MOST_ROUNDS = 1e-4, 1e-6, 500
#: Cells that one task rakes, about: there are few, and a round of few tasks is a short job.
CELLS_A_TASK = 100_000


def topic(text: Column) -> Column:
    """A plain topic by form: empty, table, symbols (over a quarter of the characters
    are neither letters, blanks nor marks of a sentence), capitals (over a third are), short or prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    symbols = F.length(F.regexp_replace(t, r"[\p{L}\s.,;:!?'\"()-]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return (
        F.when(F.trim(t) == "", "empty")
        .when(t.rlike(r"(?m)^[^\n|]*\|[^\n|]*\||\t[^\n\t]*\t"), "table")
        .when(symbols * 4 > size, "symbols")
        .when(capitals * 3 > size, "capitals")
        .when(size < 400, "short")
        .otherwise("prose")
    )


def words(text: Column) -> Column:
    """Words between white space: the tokens whose shares are raked."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def tempered(cells: DataFrame, margins: list[str], power: float) -> dict[str, DataFrame]:
    """Targets (value, share) of each margin: its token share to a power, below 1 to flatten."""
    out = {}
    for m in margins:
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
        total = sums.agg(F.sum("p").alias("total"))
        out[m] = sums.crossJoin(F.broadcast(total)).select(F.col(m).alias("value"), (F.col("p") / F.col("total")).alias("share"))  # total: one row
    return out


def _off(now: DataFrame, margins: list[str], targets: dict[str, DataFrame], total: int) -> float:
    """The largest error of any margin's share."""
    gaps = None
    for m in margins:
        sums = now.groupBy(m).agg((F.sum(F.col("tokens") * F.col("weight")) / total).alias("is"))
        gap = sums.join(targets[m], F.col(m).eqNullSafe(F.col("value")), "full").select(F.abs(F.coalesce("is", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))).alias("gap"))
        gaps = gap if gaps is None else gaps.union(gap)
    return gaps.agg(F.max("gap")).first()[0] or 0.0


def raked(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame], tasks: int = 1) -> tuple[DataFrame, float]:
    """cells (margins, tokens) with a weight each, and the largest error left.

    ValueError if a target asks for tokens of a value that no cell has tokens of.
    Targets that contradict each other can't be met: a warning names the error left
    once no weight grows any more.
    """
    kept = stored(cells.withColumn("weight", F.lit(1.0)))
    now = kept.coalesce(tasks)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return now, 0.0
    for m in margins:
        some = cells.where("tokens > 0").select(m).distinct()
        lost = targets[m].where("share > 0").join(some, F.col("value").eqNullSafe(F.col(m)), "left_anti").select("value").limit(5).collect()
        if lost:
            raise ValueError(f"no tokens for targets of {m}: {[r[0] for r in lost]}")
    for rounds in range(1, MOST_ROUNDS + 1):
        now = now.withColumn("was", F.col("weight"))
        for m in margins:
            sums = now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("s"))
            goal = targets[m].select(F.col("value").alias("v"), "share")
            factor = sums.join(goal, F.col(m).eqNullSafe(F.col("v")), "left").select(F.col(m).alias("k"), F.when(F.col("s") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("s")).otherwise(0.0).alias("f"))
            # Stored each time: it is read twice, and a plan that doubles can't be kept.
            before, kept = kept, stored(now.join(factor, F.col(m).eqNullSafe(F.col("k"))).select(*cells.columns, "was", (F.col("weight") * F.col("f")).alias("weight")))
            now = kept.coalesce(tasks)
            forget(before)
        error = _off(now, margins, targets, total)
        if error <= TOLERANCE:
            break
        gain = now.where("tokens > 0 and was > 0").agg(F.max(F.col("weight") / F.col("was"))).first()[0] or 0.0
        if gain < 1 + STILL:  # no cell is on its way up: the margins contradict each other
            break
    if error > TOLERANCE:
        warnings.warn(f"after {rounds} rounds of raking a share is off by {error:.2g}", stacklevel=2)
    return now.drop("was"), error


def scale_for(cells: DataFrame, budget: float) -> float:
    """The scale at which min(1, scale * weight) keeps budget tokens in expectation;
    infinite if the weighted cells hold no more than that. Cells that the scale
    so far would keep whole leave the sum, until none is added: a few aggregates."""
    some = cells.where("weight > 0 and tokens > 0")
    held = some.agg(F.sum("tokens")).first()[0] or 0
    if held <= budget:
        return math.inf
    scale = 0.0
    while True:
        whole = F.col("weight") * F.lit(scale) >= 1
        kept, rest = some.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)), F.sum(F.when(~whole, F.col("tokens") * F.col("weight")))).first()
        new = (budget - kept) / rest
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def mix(docs: DataFrame, margins: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None, power: float = 0.5, budget: float = 0.5, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """docs' rows as (doc_id, one column per margin, tokens, weight, probability,
    sampled, margin_error), and with keep the whole row as a struct named row.

    margins: name and expression of each; null is a value like any other.
    targets: per margin a table (value, share); without one its token shares to
    the power given. A value without a target gets weight 0. budget: share of
    all tokens to keep. margin_error: the largest error of a share after raking.
    Rows without tokens have no influence and keep their cell's probability (0
    in cells without tokens). Ids are integers or null; repeated rows draw
    alike. Columns of docs that have a margin's name don't clash with it. An
    empty table gives an empty result.
    """
    names = list(margins)
    whole = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep else []
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[e.alias(n) for n, e in margins.items()], tokens.cast("bigint").alias("tokens"), draw.alias("draw"), *whole)
    if not keep:
        rows = stored(rows)  # read twice below: texts are looked at once
    cells = stored(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    tasks = 1 + cells.count() // CELLS_A_TASK
    cells = cells.coalesce(tasks)
    goals = {m: stored(t.coalesce(tasks)).coalesce(tasks) for m, t in ((targets or {}) | {m: t for m, t in tempered(cells, names, power).items() if m not in (targets or {})}).items()}
    weighed, error = raked(cells, names, goals, tasks)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = scale_for(weighed, budget * total)
    p = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(float(min(scale, 1e300))))).otherwise(0.0)
    weighted = weighed.select(*[F.col(n).alias(f"_{n}") for n in names], "weight", p.alias("probability"))
    same = None
    for n in names:
        one = F.col(n).eqNullSafe(F.col(f"_{n}"))
        same = one if same is None else same & one
    kept = [F.col("row")] if keep else []
    return rows.join(weighted, same).select("doc_id", *names, "tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled"), F.lit(float(error)).alias("margin_error"), *kept)


def document_mix(docs: DataFrame, budget: float = 0.5, keep: bool = False) -> DataFrame:
    """mix() of documents to flattened shares of source, language and topic."""
    return mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}, words(F.col("text")), budget=budget, keep=keep)


def sampled(docs: DataFrame, budget: float = 0.5) -> DataFrame:
    """The rows of docs that document_mix() samples, all columns; rows are drawn one
    by one, so null and repeated ids are treated as all others."""
    return document_mix(docs, budget, keep=True).where("sampled").select("row.*")
