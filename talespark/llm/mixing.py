"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Blocks of a source, and parts of the block in which its budget ends.
BLOCKS = 4096
#: Up to this many sources the plan, a row each, is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


@dataclass
class Mixture:
    """exponent: power of the token shares; plan: a row per source, see plan_mixture; sources: their number, those without tokens included."""

    exponent: float
    plan: DataFrame
    sources: int


def _levels(at: float, to: float, depth: int) -> list[float]:
    return [at + (to - at) * k / (1 << depth) for k in range((1 << depth) + 1)]


def _tried(totals: DataFrame, total: float, tries: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy of the weights, passes over the source that is repeated most) at each exponent, in one aggregation."""
    share = F.col("tokens") / F.lit(float(total))
    log = F.log(F.col("tokens") / F.col("top"))
    sums = []
    for k, a in enumerate(tries):
        power = F.exp(log * F.lit(a))
        sums += [F.sum(power).alias(f"z{k}"), F.sum(power * log).alias(f"s{k}"), F.max(power / share).alias(f"m{k}")]
    row = totals.agg(*sums).first()
    return [(math.log(row[f"z{k}"]) - a * row[f"s{k}"] / row[f"z{k}"], row[f"m{k}"] / row[f"z{k}"] * budget / total) for k, a in enumerate(tries)]


def _bisected(totals: DataFrame, total: float, low: float, high: float, budget: float, done: Callable[[float, float], bool], rounds: int, depth: int) -> tuple[float, float]:
    """A narrow (low, high) between which ``done`` of entropy and passes becomes true, given that it is at ``high``; equal if it is at ``low``."""
    for _ in range(rounds):
        tries = _levels(low, high, depth)
        first = next((k for k, seen in enumerate(_tried(totals, total, tries, budget)) if done(*seen)), len(tries) - 1)
        if first == 0:
            return low, low
        low, high = tries[first - 1], tries[first]
    return low, high


def temperature_exponent(totals: DataFrame, total: float, target_entropy: float, epochs: float, budget: float, rounds: int = 6, depth: int = 5, most: float = 1024.0) -> float:
    """The least exponent a at which weights share ** a have at most the target entropy and no source repeats over ``epochs`` times.

    Entropy falls as a rises; the most passes over a source fall until a = 1 and rise again beyond. So if the shares
    themselves (a = 1) reach the target, both limits are met by bisection in [0, 1]. If not, shares are sharpened: a is
    bisected above 1, the upper end doubled until it holds the target, up to the exponent at which the target is met or,
    if this comes first, the last one that keeps the repetition limit. Sources of equal size keep 1;
    ``most`` bounds the search where the largest are equal. If even a = 1 repeats too much (a budget above epochs * total), a is 1. Each round evaluates
    the midpoints of ``depth`` halvings in one aggregation, and only sums reach the driver.
    """
    tops = totals.crossJoin(totals.agg(F.max("tokens").alias("top")))  # one row of one number
    (entropy, passes), = _tried(tops, total, [1.0], budget)
    if passes > epochs + 1e-12:
        return 1.0
    if entropy <= target_entropy + 1e-12:
        return _bisected(tops, total, 0.0, 1.0, budget, lambda e, n: e <= target_entropy + 1e-12 and n <= epochs + 1e-12, rounds, depth)[1]
    over = lambda e, n: e <= target_entropy + 1e-12 or n > epochs + 1e-12
    ends = [2.0**k for k in range(1, 1 + int(math.log2(most)))]
    seen = _tried(tops, total, ends, budget)
    end = next((a for a, s in zip(ends, seen) if over(*s)), None)
    if end is None:
        return ends[-1] if seen[-1][0] < entropy - 1e-9 else 1.0
    low, high = _bisected(tops, total, 1.0, end, budget, over, rounds, depth)
    return low if _tried(tops, total, [high], budget)[0][1] > epochs + 1e-12 else high


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit("row"), F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def _spots(seed: int, source: str = "__source", key: str = "__key", full: str = "__full") -> dict[str, Column]:
    """Block and part of a row, and their places in the permutation of the epoch in which the source's budget ends."""
    block, part = F.pmod(F.xxhash64(F.lit("block"), key), F.lit(BLOCKS)), F.pmod(F.xxhash64(F.lit("part"), key), F.lit(BLOCKS))
    return {
        "__block": block, "__part": part,
        "__block_place": F.xxhash64(F.lit(seed), source, full, F.lit("block"), block),
        "__part_place": F.xxhash64(F.lit(seed), source, full, F.lit("part"), block, part),
    }


def _ends(sums: DataFrame, place: str, room: str) -> DataFrame:
    """For each source, the first of its blocks (or parts), in their permuted order, that its room does not hold, and the room left there.

    A source has at most BLOCKS rows here, however large it is.
    """
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("__source").orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = sums.withColumn("before", before).filter(F.col("before") + F.col("tokens") > F.col(room))
    return over.groupBy("__source").agg(F.min(F.struct(F.col(place).alias("at"), (F.col(room) - F.col("before")).alias("left"))).alias("end"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, __source, tokens, __key) of each row: tokens are words of the whole text."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), _key(docs, id_col, text_col).alias("__key"),
    )


def plan_mixture(rows: DataFrame, entropy_share: float = 0.95, epochs: float = 4.0, budget: float | None = None, seed: int = 7) -> Mixture:
    """How often each source is drawn: rows come from measured(), materialised.

    Weights are token shares to the power found by temperature_exponent, for a target entropy of ``entropy_share`` times
    that of equal sources. A source with weight w gets w * budget tokens (budget: all tokens, unless given): ``__full``
    passes over all its rows, then blocks of its rows in a permuted order while they fit, then parts of the next block
    while they fit; so a source misses its budget by less than one part, about a 16-millionth of its rows or a row.
    plan: (__source, weight, __full, end: the first block place left out, end_part: the first part place left out there).
    """
    totals = cut(rows.groupBy("__source").agg(F.sum("tokens").alias("tokens")))
    some = totals.filter("tokens > 0")
    total, count, sources = totals.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0), F.count("*")).first()
    if not count:
        plan = totals.select("__source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("__full"), F.lit(0.0).alias("room"))
        return Mixture(1.0, plan.withColumns({"end": F.lit(None).cast("long"), "end_part": F.lit(None).cast("long")}), sources)
    total = float(total)
    budget = float(budget or total)
    a = temperature_exponent(some, total, entropy_share * math.log(count), epochs, budget)
    z = some.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a)))).first()[0]
    weight = F.pow(F.col("tokens") / total, F.lit(a)) / z
    due = F.when(F.col("tokens") > 0, weight * budget).otherwise(F.lit(0.0))
    plan = totals.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0)))
    plan = plan.withColumn("__full", F.when(F.col("tokens") > 0, F.floor(due / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("long"))  # a source without tokens is passed once
    plan = cut(plan.withColumn("room", F.greatest(F.lit(0.0), due - F.col("__full") * F.col("tokens"))).drop("tokens"))
    hint = F.broadcast if sources <= BROADCAST_SOURCES else (lambda x: x)  # the plan has a row for every source
    met = rows.join(hint(plan), "__source").withColumns(_spots(seed))
    blocks = met.groupBy("__source", "room", "__block_place").agg(F.sum("tokens").alias("tokens"))
    ends = cut(_ends(blocks, "__block_place", "room").select("__source", F.col("end.at").alias("end"), F.col("end.left").alias("left")))
    parts = met.join(hint(ends), "__source").filter(F.col("__block_place") == F.col("end")).groupBy("__source", "left", "__part_place").agg(F.sum("tokens").alias("tokens"))
    last = _ends(parts, "__part_place", "left").select("__source", F.col("end.at").alias("end_part"))
    plan = cut(plan.join(ends.drop("left"), "__source", "left").join(last, "__source", "left"))
    return Mixture(a, plan, sources)


def _draws(rows: DataFrame, mixture: Mixture, seed: int) -> DataFrame:
    """``rows`` with __source and __key, once for each time they are drawn; adds epoch and the place within it."""
    plan = F.broadcast(mixture.plan) if mixture.sources <= BROADCAST_SOURCES else mixture.plan
    met = rows.join(plan, "__source").withColumns(_spots(seed))
    more = F.col("end").isNull() | (F.col("__block_place") < F.col("end")) | ((F.col("__block_place") == F.col("end")) & (F.col("end_part").isNull() | (F.col("__part_place") < F.col("end_part"))))
    partly = more & (F.col("room") >= 1)  # less than a token's room is rounding noise: nothing fits
    times = F.col("__full") + partly.cast("long")
    return met.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))


def mix_sources(docs: DataFrame, entropy_share: float = 0.95, epochs: float = 4.0, budget: float | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, block_place): a row for each draw of each document.

    Order by (epoch, block_place) for the mixture's sequence: blocks of all sources, permuted anew in each epoch. A null
    source is a source named ''; null texts have no tokens and follow their source; a source without any tokens is drawn
    once. Repeated rows are drawn alike; null ids stay null; other columns are not read; an empty table gives no rows.
    """
    rows = cut(measured(docs, id_col, text_col, source_col))
    drawn = _draws(rows, plan_mixture(rows, entropy_share, epochs, budget, seed), seed)
    place = F.xxhash64(F.lit(seed), "__source", "epoch", F.lit("block"), "__block")
    return drawn.select(F.col("id").alias("doc_id"), F.col("__source").alias("source"), F.col("tokens").alias("n_tokens"), "weight", F.col("epoch").cast("int"), F.col("__block").cast("int").alias("block"), place.alias("block_place"))


def mixed_documents(docs: DataFrame, entropy_share: float = 0.95, epochs: float = 4.0, budget: float | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row as often as mix_sources() draws it; its columns only, whatever their names.

    Texts are not shuffled unless there are more than BROADCAST_SOURCES sources. Nulls, empty texts, repeated rows and empty tables are treated as there.
    """
    rows = cut(measured(docs, id_col, text_col, source_col))
    mixture = plan_mixture(rows, entropy_share, epochs, budget, seed)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(whole.alias("__row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), _key(docs, id_col, text_col).alias("__key"))
    return _draws(named, mixture, seed).select("__row.*")
