"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rules that reject a text whose measure lies above a cutoff.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts over each whole text: (doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Everything happens within a row, without a shuffle. Three-word windows are sorted by their hash, then their words,
    with their places, so a text of n words costs n log n; a text in which all hashes differ skips the sort.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    split = split.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    split = split.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = split.select(
        "doc_id", "stratum", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    word = lambda i: F.get(F.col("words"), i)
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<long>"))
    counted = counted.withColumn("windows", windows)
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    # Hashes only find texts that may have repeated windows; there, the words themselves are compared.
    window = lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))
    counted = counted.withColumn("placed", F.when(twice, F.sort_array(F.transform("windows", window)))).drop("windows", "words")
    same = lambda x, k: F.coalesce((F.get(F.col("placed"), k)["h"] == x["h"]) & (F.get(F.col("placed"), k)["w"] == x["w"]), F.lit(False))
    found = F.transform(F.filter("placed", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    counted = counted.withColumn("found", F.sort_array(found)).drop("placed")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("found", start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).alias("n")), lambda a: a["n"])
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("found")


def base_failed(least_words: int = 50, most_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def _measures(counts: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.withColumns({"symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")})


def _log_factorial(n: Column) -> Column:
    """ln(n!), from the factorial itself up to 15, from Stirling's series beyond, right to about 1e-12."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.log(F.factorial(F.greatest(F.lit(0), F.least(n, F.lit(15))).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, x: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= x), the p-value of "the risk is above ``risk``" when x of n good texts would be rejected.

    Summed from x down; terms fall faster than a bell curve, so those beyond 12 deviations add nothing a double can hold.
    1 where x is n * risk or more: no bound can hold there.
    """
    n, x = n.cast("long"), x.cast("long")
    first = _log_factorial(n) - _log_factorial(x) - _log_factorial(n - x) + x * math.log(risk) + (n - x) * math.log1p(-risk)
    steps = F.least(x, F.ceil(12 * F.sqrt(n * risk)) + 50)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, k: Column) -> Column:
        i = x - k + 1
        term = a["term"] * i / (n - i + 1) * ((1 - risk) / risk)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    down = F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(down, start, add, lambda a: a["sum"])
    return F.when(x >= n * risk, 1.0).otherwise(F.exp(first) * total)


def _with_stratum(rows: DataFrame, table: DataFrame, how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` with their stratum's row of ``table``; a large stratum's rows are dealt over ``salts`` copies of it."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, ["stratum", "__salt"], how).drop("__salt")


def risk_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, steps: int = 24) -> DataFrame:
    """(stratum, n_good, one cutoff per rule): the lowest cutoffs whose false rejection is proven small.

    Half of the labelled texts, by a hash of the id, only propose cutoffs: quantiles of each measure in each stratum. On
    the other half, the holdout, a cutoff is valid if the exact binomial test rejects "more than risk / rules of the good
    texts are lost" at level delta / (rules * steps * strata), Bonferroni's correction for every test made. So with
    probability 1 - delta, no stratum loses more than ``risk`` of its good texts to all rules together. A rule without a
    valid cutoff in a stratum has a null there and rejects nothing; neither does a stratum without labels. Rows that
    repeat an id are one vote, that of the least counts: the bound needs votes that do not depend on each other.
    """
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("quality")).filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counted = counts.join(cut(rated), "doc_id")  # written, so Spark can split an id that many rows share
    votes = [c for c in counted.columns if c not in ("doc_id", "quality")]
    once = counted.groupBy("doc_id", "quality").agg(F.min(F.struct(*votes)).alias("v")).select("doc_id", "quality", "v.*")
    known = _measures(once.filter(~base_failed())).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    quantiles = [1 - 0.75 ** (k + 1) for k in range(steps)]  # closer to 1 in equal ratios, where few good texts lie above
    proposed = known.filter("half = 0").groupBy("stratum").agg(*(F.percentile_approx(r, quantiles, 10000).alias(f"cuts_{r}") for r in RULES))
    good = _with_stratum(known.filter("half = 1 and quality >= 1"), proposed)
    lost = [F.sum((F.col(r) > F.col(f"cuts_{r}")[k]).cast("long")).alias(f"lost_{r}_{k}") for r in RULES for k in range(steps)]
    seen = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *lost).join(proposed, "stratum").crossJoin(proposed.agg(F.count("*").alias("strata")))  # one row of one number
    out = ["stratum", "n_good"]
    for r in RULES:
        cases = F.array(*(F.struct(F.col(f"cuts_{r}")[k].alias("at"), F.col(f"lost_{r}_{k}").alias("lost")) for k in range(steps)))
        valid = F.filter(cases, lambda c: binomial_tail(F.col("n_good"), c["lost"], risk / len(RULES)) <= delta / (len(RULES) * steps) / F.col("strata"))
        out.append(F.array_min(F.transform(valid, lambda c: c["at"])).alias(f"cut_{r}"))
    return seen.select(*out)


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, rules_broken).

    A text is kept if it passes the base rule and lies above no risk-controlled cutoff of its stratum (risk_cutoffs).
    Null and empty texts have no words and fail the base rule. A null stratum is one with the empty stratum. Repeated rows and
    repeated or null ids each get a row. Extra columns, whatever their names, are not read. Without labels, only the
    base rule rejects. An empty table gives no rows.
    """
    counts = cut(text_measures(docs, id_col, text_col, stratum_col))
    cutoffs = cut(risk_cutoffs(counts, labels, risk, delta))
    met = _with_stratum(_measures(counts), cutoffs.drop("n_good"), "left")
    broken = F.array_compact(F.array(*(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    met = met.withColumn("rules_broken", F.array_join(broken, ",")).withColumn("base_failed", base_failed())
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rules_broken") == "")).alias("kept"), "stratum", "rules_broken")
