"""Two emotion labels for each line: ordered rules, context cues, keyword scores, fallback. Native but for the keywords' automaton."""

from __future__ import annotations

import re._parser as parser
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespark.data import load
from talespark.functions.text import bind
from talespark.operators.lexicons import lexicon_matches, lexicon_scores

TABLE = "emotion_rules"


def with_context(lines: DataFrame) -> DataFrame:
    """``lines`` with before and after: the texts of the story's previous and next line."""
    order = W.partitionBy("story_id").orderBy("line_no")
    return lines.withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})


def emotion_source(text: Column, attribution: Column, before: Column, after: Column) -> Column:
    """What the tagger reads: the line with its attribution, then its neighbours, blank parts left out."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (text, attribution, before, after)))


def _pair(a: str, b: str) -> Column:
    return F.array(F.lit(a), F.lit(b))


def seeds(pattern: str) -> set[str]:
    """Literals of which every match of a pattern holds at least one; none if there is no such set."""

    def of(parts: list) -> set[str]:
        runs, run, options = [], "", []
        for kind, value in [*parts, (None, None)]:
            if kind is parser.LITERAL:
                run += chr(value)
                continue
            if run:
                runs.append(run)
                run = ""
            if kind is parser.SUBPATTERN:
                options.append(of(list(value[3])))
            elif kind is parser.BRANCH:
                every = [of(list(x)) for x in value[1]]
                options.append(set().union(*every) if all(every) else set())
            elif kind is parser.MAX_REPEAT and value[0] > 0:
                options.append(of(list(value[2])))
        options = ([{max(runs, key=len)}] if runs else []) + [o for o in options if o]
        return max(options, key=lambda o: min(map(len, o)), default=set())

    return of(list(parser.parse(pattern)))


def rule_labels(source: Column) -> Column:
    """The pair of the first rule that matches the lower-cased source, or null.

    A pattern is only tried on texts that hold one of its literals, which is far cheaper to see.
    """

    def first(low: Column) -> Column:
        found = None
        for pattern, a, b in load(TABLE)["rules"]:
            hit = low.rlike(f"(?U){pattern}")
            if literals := seeds(pattern):
                hit = reduce(or_, (F.contains(low, F.lit(x)) for x in sorted(literals))) & hit
            found = F.when(hit, _pair(a, b)) if found is None else found.when(hit, _pair(a, b))
        return found

    return bind(F.lower(source), first)


def cue_counts(source: Column) -> dict[str, Column]:
    """For each signal, how many of its distinct cues the source contains."""
    count = lambda cues: bind(F.lower(F.coalesce(source, F.lit(""))), lambda low: sum((F.contains(low, F.lit(c)).cast("int") for c in cues), F.lit(0)))
    return {signal: count(cues) for signal, cues in load(TABLE)["cues"].items()}


def context_labels(n: dict[str, Column]) -> Column:
    """The pair that the signals ``n`` (arousal, romance, dominance, tension) stand for, or null."""
    a, r, d, t = (n[k] for k in ("arousal", "romance", "dominance", "tension"))
    return (
        F.when((a >= 2) | ((a > 0) & (r > 0)), _pair("aroused", "breathless"))
        .when(r >= 2, _pair("romantic", "soft"))
        .when((d > 0) & ((a > 0) | (t > 0)), _pair("dominant", "commanding"))
        .when(d >= 2, _pair("dominant", "aggressive"))
        .when(t >= 2, _pair("intense", "shaky"))
    )


def fallback_labels(n: dict[str, Column]) -> Column:
    return F.when(n["arousal"] > 0, _pair("aroused", "breathless")).when(n["romance"] > 0, _pair("romantic", "soft")).when(n["dominance"] > 0, _pair("dominant", "commanding")).when(n["tension"] > 0, _pair("intense", "soft")).otherwise(_pair("soft", "calm"))


def keyword_scores(source: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """(less: the score below zero, k, label) of each label of the lexicon, in its order: 1 for each occurrence of a word, 2 for a phrase.

    One pass of an automaton over the whole text; see lexicons. The array sorts by score, then by order.
    """
    lexicon = load(TABLE)["lexicon"] if lexicon is None else lexicon
    labels = F.array(*map(F.lit, lexicon)) if lexicon else F.array().cast("array<string>")
    return F.transform(lexicon_scores(source, lexicon, load(TABLE)["negations"]), lambda n, k: F.struct((-n).alias("less"), k.alias("k"), F.get(labels, k).alias("label")))


def keyword_labels(source: Column, lexicon: dict[str, list[str]] | None = None, top: int = 2) -> Column:
    ranked = F.filter(F.array_sort(keyword_scores(source, lexicon)), lambda x: x["less"] < 0)
    return F.slice(F.transform(ranked, lambda x: x["label"]), 1, top)


def finish_labels(labels: Column, fallback: Column) -> Column:
    """Exactly two distinct labels: blanks and neutral go, a lone label gets its companion, none the fallback."""
    kept = F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "neutral")))
    pairs = F.create_map(*(F.lit(x) for kv in load(TABLE)["companions"].items() for x in kv))
    lone = F.get(kept, F.lit(0))
    mate = F.coalesce(F.try_element_at(pairs, F.lower(lone)), F.lit("soft"))
    mate = F.when(mate != F.lower(lone), mate).when(F.lower(lone) != "calm", F.lit("calm")).otherwise(F.lit("soft"))
    return F.when(F.size(kept) >= 2, F.slice(kept, 1, 2)).when(F.size(kept) == 1, F.array(lone, mate)).otherwise(fallback)


def tag_emotions(lines: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """``lines`` with ``emotions``, two labels each. The text of rules and cues is the line, its attribution and its neighbours.

    Keywords are only scored where neither a rule nor the context decides.
    """
    rows = with_context(lines).withColumn("__source", emotion_source(F.col("text"), F.col("attribution"), F.col("before"), F.col("after"))).drop("before", "after")
    rows = rows.withColumns({f"__{k}": c for k, c in cue_counts(F.col("__source")).items()})  # columns of their own: read many times
    n = {k: F.col(f"__{k}") for k in load(TABLE)["cues"]}
    first = F.coalesce(rule_labels(F.col("__source")), context_labels(n))
    rows = rows.withColumn("__first", first)
    undecided = F.when(F.col("__first").isNull(), F.col("__source"))  # no other text need leave the JVM
    found = F.coalesce("__first", keyword_labels(undecided, lexicon))
    rows = rows.withColumn("__found", found)  # a column of its own: what follows reads it many times
    return rows.withColumn("emotions", finish_labels(F.col("__found"), fallback_labels(n))).drop("__source", "__first", "__found", *(f"__{k}" for k in n))


def lexicon_metadata(lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, keywords) counts, and (keyword, labels) of keywords under more than one label, of rows (label, idx, keyword)."""
    counts = lexicon.groupBy("label").agg(F.count("*").alias("keywords"))
    shared = lexicon.groupBy(F.lower("keyword").alias("keyword")).agg(F.sort_array(F.collect_set("label")).alias("labels")).filter(F.size("labels") > 1)
    return counts, shared


def explain_emotions(lines: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """``lines`` with ``matches``: (label, keyword, start, end, negated) of every keyword occurrence in ``text``, in the lexicon's order."""
    lexicon = load(TABLE)["lexicon"] if lexicon is None else lexicon
    return lines.withColumn("matches", lexicon_matches(F.col("text"), lexicon, load(TABLE)["negations"]))
