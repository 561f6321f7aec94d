"""Audit of interacting filters: every order of the filters replayed over the documents' flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: The filters, by letter.
FILTERS = "ABCDE"


def _failures(text: Column, words: Column, least_words: int, distinct_percent: int, capital_percent: int) -> dict[str, Column]:
    """Filters that look at one text: too few words, too few different ones, too many capitals, signs."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < least_words,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * n.cast("long"),
        "C": 100 * capitals.cast("long") > capital_percent * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def filter_flags(docs: DataFrame, labels: DataFrame, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row: which filters it fails, and its labels.

    E fails a text that is that of a smaller id. Equal texts meet by their SHA-256 in a table of least ids, written
    before it is joined, as the one of labels is, so that Spark can split a text or an id that a third of all rows share.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    failed = _failures(F.col("text"), F.col("words"), least_words, distinct_percent, capital_percent)
    flags = cut(read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("content"), *(c.alias(f) for f, c in failed.items())))
    copied = cut(flags.groupBy("content").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").drop("n"))
    rated = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id is not null and (quality = 1 or toxic = 1)")
    rated = cut(rated.groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    met = flags.join(copied, "content", "left").join(rated, "id", "left")
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return met.select("part", *FILTERS[:-1], late.alias("E"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


def replay_orders(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of flags (part, a column for each filter, good, toxic).

    Rows with equal flags in a part are counted first, on the map side. What is left, with its counts, meets all orders of
    the filters (a broadcast table of n! rows, n the number of filters, which is fixed), each order is exploded into its
    steps, and sums by the first step that fails follow.
    """
    spark = flags.sparkSession
    orders = F.broadcast(spark.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string"))
    counted = flags.groupBy("part", *filters, "good", "toxic").agg(F.count("*").alias("n"))
    failed = F.array_compact(F.array(*(F.when(F.col(f), f) for f in filters)))
    crossed = counted.select("part", failed.alias("failed"), "good", "toxic", "n").crossJoin(orders)
    places = F.transform("failed", lambda f: F.instr(F.col("filter_order"), f))
    crossed = crossed.withColumn("first", F.coalesce(F.array_min(places), F.lit(len(filters) + 1)))
    steps = crossed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    here, fails = F.col("first") == F.col("step"), F.array_contains("failed", own)
    sums = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": fails & (F.size("failed") == 1),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    counts = steps.groupBy("part", "filter_order", "step").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in sums.items()))
    shapley = F.sum("removed").over(W.partitionBy("part", own))  # n! rows for each filter of a part
    return counts.withColumn("shapley", shapley)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """replay_orders() of filter_flags(): what each filter does at each place of each order, for each source.

    Null and empty texts have no words: they fail A, and E if a smaller id has one. A null source is one named ''. Rows that
    repeat an id are documents of their own; none of them is a copy of another, as no id is smaller. A null id is no copy
    and has no labels; copies of its text are not copies for its sake. Of several labels of an id any counts. Other
    columns, of any names, are not read. An empty table gives no rows.
    """
    return replay_orders(filter_flags(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
