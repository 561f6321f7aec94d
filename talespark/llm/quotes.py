"""Chat formatting: quotations are linked to the messages they come from, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespark.functions.text import bind

from .common import cut

#: Turns of a conversation whose passages are searched in one window.
TURNS = 1024
#: The end of a line that says whom the quote below it is from.
_LEAD = r"\b(?:wrote|writes|said|schrieb|escribi[oó]|a écrit)[ \t]*:\s*\z"


def normal(passage: Column) -> Column:
    """Lower case, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"(?U)\s+", " "))


def marked_lines(text: Column) -> Column:
    """The lines of a text: level (marks before it, any number), body (what follows them), lead (whether it introduces a quote)."""

    def mark(line: Column) -> Column:
        marks = F.regexp_extract(line, r"\A[ \t>]*>", 0)
        lead = ~F.contains(line, F.lit(">")) & line.rlike(_LEAD)
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("level"), F.substr(line, F.length(marks) + 1).alias("body"), lead.alias("lead"))

    return F.transform(F.split(text, "\n"), mark)


def _level(lines: Column, k: Column) -> Column:
    return F.coalesce(F.get(lines, k)["level"], F.lit(0))


def unquoted(text: Column) -> Column:
    """``text`` without quoted lines, the lines that introduce them, and blank lines left at its ends."""

    def own(lines: Column) -> Column:
        kept = F.filter(lines, lambda x, k: (x["level"] == 0) & ~(x["lead"] & (_level(lines, k + 1) > 0)))
        return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"\A\s+|\s+\z", "")

    return bind(marked_lines(text), own)


def quoted(text: Column) -> Column:
    """(level, passage) of each quoted passage: neighbouring lines with one number of marks, without the marks."""

    def runs(lines: Column) -> Column:
        ends = lambda step: F.filter(F.transform(lines, lambda x, k: F.when((x["level"] > 0) & (_level(lines, k + step) != x["level"]), k)), lambda k: k.isNotNull())
        passage = lambda a, b: F.array_join(F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: x["body"]), "\n")
        return F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(_level(lines, a).alias("level"), passage(a, b).alias("passage")))

    return bind(marked_lines(text), runs)


def _units(own: Column) -> Column:
    """Passages by which a message's own words can be quoted: all of them, each paragraph, each line; normalised, distinct."""
    parts = lambda x: F.concat(F.array(x), F.split(x, r"\n[ \t]*\n"), F.split(x, "\n"))
    return F.filter(F.array_distinct(F.transform(bind(own, parts), normal)), lambda p: p != "")


def _hash(passage: Column) -> Column:
    """What names a passage: 256 bits, so that equal names mean equal passages."""
    return F.sha2(passage, 256)


def _latest_source(units: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` (conv, hash, turn, ...) with ``parent``: the last earlier turn of the conversation that holds the passage.

    An as-of join without pairs: within a block of turns a window carries the last holder, and the last holder of earlier
    blocks is carried over per-block maxima, so a passage that a whole conversation repeats is cut into blocks.
    """
    asked = asks.select("conv", "hash").distinct()
    held = units.join(asked, ["conv", "hash"], "left_semi").select("conv", "hash", "turn", F.col("turn").alias("holder")).distinct()
    wanted = asks.select("conv", "hash", "turn").distinct()
    both = held.unionByName(wanted.withColumn("holder", F.lit(None).cast("long"))).withColumn("block", F.expr(f"turn div {TURNS}"))
    both = both.groupBy("conv", "hash", "block", "turn").agg(F.max("holder").alias("holder"), F.max(F.col("holder").isNull()).alias("asks"))
    near = F.last("holder", ignorenulls=True).over(W.partitionBy("conv", "hash", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    own = both.withColumn("near", near).filter("asks")
    blocks = both.groupBy("conv", "hash", "block").agg(F.max("holder").alias("top"))
    far = F.last("top", ignorenulls=True).over(W.partitionBy("conv", "hash").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    found = own.join(blocks.withColumn("far", far).drop("top"), ["conv", "hash", "block"]).select("conv", "hash", "turn", F.coalesce("near", "far").alias("parent")).filter("parent is not null")
    return asks.join(found, ["conv", "hash", "turn"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, parent, n_linked): the earlier message that each message replies to by quoting it.

    A quoted passage, whole or by line, is linked if its normalised hash is that of a passage of an earlier message's own
    words. The outermost level decides, then the longest linked passage, then the latest message.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text.alias("text")).filter("conv is not null and turn is not null")
    # Outer explosions: an inner one makes the optimiser filter by the array's size, which computes it twice.
    asks = known.filter(F.col("text").contains(">")).select("conv", "turn", F.explode_outer(quoted(F.col("text"))).alias("p")).filter("p is not null")
    asks = asks.select("conv", "turn", "p.level", F.explode_outer(_units(F.col("p.passage"))).alias("passage")).filter("passage is not null")
    asks = cut(asks.select("conv", "turn", "level", F.length("passage").alias("size"), _hash(F.col("passage")).alias("hash")).distinct())
    units = known.select("conv", "turn", F.explode_outer(_units(unquoted(F.col("text")))).alias("passage")).filter("passage is not null").select("conv", "turn", _hash(F.col("passage")).alias("hash"))
    met = _latest_source(units, asks)
    best = F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("parent")).alias("parent")))
    return met.groupBy("conv", "turn").agg((-best["parent"]).alias("parent"), F.countDistinct("hash").alias("n_linked"))


def _next_siblings(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, sibling): the next message with the same parent, or null; in blocks of turns, as many may share one."""
    rows = links.select("conv", "turn", "parent", F.expr(f"turn div {TURNS}").alias("block"))
    near = F.lead("turn").over(W.partitionBy("conv", "parent", "block").orderBy("turn"))
    blocks = rows.groupBy("conv", "parent", "block").agg(F.min("turn").alias("head"))
    far = F.lead("head").over(W.partitionBy("conv", "parent").orderBy("block"))
    met = rows.withColumn("near", near).join(cut(blocks.withColumn("far", far).drop("head")), ["conv", "parent", "block"])
    return met.select("conv", "turn", "parent", F.coalesce("near", "far").alias("sibling"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth, place) of linked messages and what they link to: where each stands in its thread.

    ``place`` counts from 0 at the root, replies after what they answer, earlier replies with all below them first. A
    tour enters and leaves each message once; its list is ranked by pointer doubling, so rounds follow the logarithm of
    a thread's length, every round is one join on unique keys, and no row grows with its thread.
    """
    links = cut(links.select("conv", "turn", "parent"))
    if links.isEmpty():
        return links.select("conv", "turn", F.col("parent").alias("root"), F.lit(0).alias("depth"), F.lit(0).alias("place"))
    heads = links.select("conv", F.col("parent").alias("turn")).distinct().join(links.select("conv", "turn"), ["conv", "turn"], "left_anti")
    every = _next_siblings(links).unionByName(heads.select("conv", "turn", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("sibling")))
    child = links.groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    every = cut(every.join(cut(child), ["conv", "turn"], "left"))
    # Each message is two stops of the tour: 2 * turn (enter) and 2 * turn + 1 (leave); turns may be negative.
    stops = lambda at, to, enters: every.select("conv", at.alias("at"), to.alias("to"), F.lit(enters).alias("enters"), F.lit(1 - enters).alias("leaves"))
    turn, leave = F.col("turn") * 2, F.col("turn") * 2 + 1
    now = stops(turn, F.coalesce(F.col("child") * 2, leave), 1).unionByName(stops(leave, F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1), 0))
    now = cut(now.withColumn("end", F.when(F.col("to").isNull(), F.col("at"))))
    while not now.filter("to is not null").isEmpty():
        ahead = now.select("conv", F.col("at").alias("to"), F.col("to").alias("then"), F.col("enters").alias("more_enters"), F.col("leaves").alias("more_leaves"), F.col("end").alias("last"))
        met = now.join(ahead, ["conv", "to"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        now = cut(met.select("conv", "at", F.col("then").alias("to"), (F.col("enters") + zero("more_enters")).alias("enters"), (F.col("leaves") + zero("more_leaves")).alias("leaves"), F.coalesce("end", "last").alias("end")))
    # Now enters and leaves count from a stop to the end of its tour, which leaves the root.
    mine = now.filter("pmod(at, 2) = 0").select("conv", F.expr("at div 2").alias("turn"), F.expr("(end - 1) div 2").alias("root"), "enters", "leaves")
    whole = mine.filter("turn = root").select("conv", "root", F.col("enters").alias("size"))
    return mine.join(cut(whole), ["conv", "root"]).select("conv", "turn", "root", (F.col("leaves") - F.col("enters")).alias("depth"), (F.col("size") - F.col("enters")).alias("place"))


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, parent_turn, root_turn, depth, place): messages without their quotes.

    Order a conversation by (conv_id, root_turn, place) and each reply follows what it answers, threads in order of their
    first message. Messages that quote nothing known begin threads of their own. Null texts are empty. Rows without a
    conversation or turn keep their words and are linked to nothing. Rows that repeat a conversation and turn are one
    message to others, and each get a row. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    links = cut(link_quotes(messages, conv_col, turn_col, text_col))
    placed = cut(threads(links).join(links, ["conv", "turn"], "left"))
    met = own.join(placed, ["conv", "turn"], "left")
    quotes = F.col("text").contains(">")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return met.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.when(quotes, unquoted(F.col("text"))).otherwise(F.col("text")).alias("text"), F.when(quotes, F.size(quoted(F.col("text")))).otherwise(0).alias("n_quotes"),
        count("n_linked"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), count("depth"), count("place"),
    )
