"""Mixing sources by temperature, realised as whole passes and one partial pass over blocks of a permutation.

A source's weight is its token share to the power of ``exponent``, normalised. The exponent is found by
bisection: the greatest one not above 1 at which the weights have the target entropy (given as a part of
the greatest possible), raised where a source would be repeated more than ``most_repeats`` times. The
budget is a number of tokens, or the least at which every source is taken whole at least once.

A source's documents are permuted by hash and the permutation is cut into blocks. A quota is so many
whole passes and a rest; the rest takes the permutation's documents from its start as long as they fit.
Block totals are pre-aggregated, so only the one block in which the rest ends is summed row by row, and a
source that holds a third of all rows is spread over all its blocks. The rows themselves never move.

Only the table of sources is broadcast: one row each, at most ``MOST_SOURCES`` (more raise an error).

Defined cases: null sources are one source of their own; null or empty texts have 0 tokens and go with
the passes of their source; a source without tokens gets weight 0 and its rows pass once; equal rows have
one place in the permutation, so all of them are in a partial pass or none is; an empty table gives no
rows; extra columns are carried along, whatever their names, and count for a row's place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.llm.stored import store

TARGET_ENTROPY = 0.93  # of log(number of sources)
MOST_REPEATS = 4.0
BLOCKS = 256
MOST_SOURCES = 100_000
BISECTIONS = 60
SLACK = 1e-6  # tokens


@dataclass(frozen=True)
class Plan:
    exponent: float
    budget: float
    quotas: dict  # source -> tokens


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised weights of the sources that have tokens."""
    top = max(tokens.values(), default=0)
    raw = {s: math.exp(exponent * math.log(t / top)) for s, t in tokens.items() if t > 0}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def entropy(shares: dict) -> float:
    return -sum(w * math.log(w) for w in shares.values() if w > 0)


def _budget(tokens: dict, shares: dict, budget: float | None) -> float:
    return budget if budget is not None else max((tokens[s] / w for s, w in shares.items()), default=0.0)


def repeats(tokens: dict, shares: dict, budget: float) -> float:
    return max((w * budget / tokens[s] for s, w in shares.items()), default=0.0)


def plan(tokens: dict, target: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS, budget: float | None = None) -> Plan:
    """Exponent, budget and quota of each source.

    Entropy falls and repetition falls as the exponent grows from 0 to 1, so both limits are met by
    bisection; the repetition limit wins. At exponent 1 no source is repeated more than another.
    """
    live = {s: t for s, t in tokens.items() if t > 0}
    goal = target * math.log(len(live)) if len(live) > 1 else 0.0

    def greatest(holds) -> float:
        """The end of the exponents from 0 on for which ``holds``; 0 if none."""
        if holds(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    def repeated(a: float) -> bool:
        shares = weights(live, a)
        return repeats(live, shares, _budget(live, shares, budget)) > most_repeats

    exponent = greatest(lambda a: entropy(weights(live, a)) >= goal)
    exponent = max(exponent, greatest(repeated)) if repeated(exponent) else exponent
    shares = weights(live, exponent)
    spend = _budget(live, shares, budget)
    return Plan(exponent, spend, {s: shares.get(s, 0.0) * spend for s in tokens})


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def place(columns: list[Column]) -> Column:
    """A row's place in the permutation: a hash of the whole row."""
    return F.xxhash64(*columns)


def block_of(place: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(place, 32), F.lit(BLOCKS)).cast("int")


def takes(docs: DataFrame, source_col: str = "source", text_col: str = "text", target: float = TARGET_ENTROPY,
          most_repeats: float = MOST_REPEATS, budget: float | None = None) -> tuple[Plan, DataFrame]:
    """The plan, and for each source: ``source``, ``whole`` passes, and the ``block`` and ``place`` at which the
    partial pass ends (rows of earlier blocks, or of this one up to the place, are in it)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"),
        place(columns).alias("place")).withColumn("block", block_of(F.col("place")))
    blocks = store(rows.groupBy("source", "block").agg(F.sum(word_count(F.col("text"))).alias("tokens")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = {r.source: int(r.tokens) for r in totals}
    made = plan(tokens, target, most_repeats, budget)
    told = []
    for source, total in tokens.items():
        whole = int(made.quotas[source] / total + 1e-9) if total else 1
        told.append((source, whole, max(made.quotas[source] - whole * total, 0.0)))
    quotas = F.broadcast(docs.sparkSession.createDataFrame(told, "source string, whole int, rest double"))
    upto = Window.partitionBy("source").orderBy("block")
    running = blocks.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens")).alias("b").join(
        quotas.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source"))).select("b.*", "q.whole", "q.rest")
    # The first block that does not fit whole; sources whose rest holds all blocks have none.
    ends = store(running.where(F.col("before") + F.col("tokens") > F.col("rest") + SLACK).groupBy("source").agg(
        F.min(F.struct("block", "before", "rest")).alias("end")).select("source", "end.*"), "mix-ends")
    last = rows.alias("r").join(
        F.broadcast(ends).alias("e"),
        F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.block") == F.col("e.block")),
    ).select("r.source", "r.place", word_count(F.col("r.text")).alias("tokens"), "e.before", "e.rest")
    by_place = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("through", F.col("before") + F.sum("tokens").over(by_place)).where(
        F.col("through") <= F.col("rest") + SLACK).groupBy("source").agg(F.max("place").alias("place"))
    out = quotas.alias("q").join(ends.alias("e"), F.col("q.source").eqNullSafe(F.col("e.source")), "left").join(
        last.alias("l"), F.col("q.source").eqNullSafe(F.col("l.source")), "left").select(
        "q.source", "q.whole", "e.block", "l.place")
    return made, store(out, "mix-takes")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", target: float = TARGET_ENTROPY,
        most_repeats: float = MOST_REPEATS, budget: float | None = None, pass_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it; ``pass_col`` numbers its passes from 0.

    Without ``budget`` every row comes at least once. No row is shuffled.
    """
    _, ends = takes(docs, source_col, text_col, target, most_repeats, budget)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    here = place([F.col(f"d.`{c}`") for c in docs.columns])
    joined = docs.alias("d").join(
        F.broadcast(ends).alias("t"), F.col(f"d.`{source_col}`").cast("string").eqNullSafe(F.col("t.source")))
    part = F.col("t.block").isNull() | (block_of(here) < F.col("t.block")) | (
        (block_of(here) == F.col("t.block")) & F.coalesce(here <= F.col("t.place"), F.lit(False)))
    rest = F.col("t.whole") + F.when(part & F.col("t.block").isNotNull(), 1).otherwise(0)
    out = joined.where(rest > 0).select(
        F.struct(*columns).alias("row"), F.explode(F.sequence(F.lit(1), rest)).alias("number"))
    number = [(F.col("number") - 1).alias(pass_col)] if pass_col else []
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *number)
