"""Script lines: strict and flexible parsing, formatting, usage counts, voice joins and speech sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import format_line, strip
from talespark.operators.chunking import smart_cuts

#: The header of a script line, its emotions and its sound effects.
HEADER = r"\A\[([^\]]+)\]\s*(\([^)]+\))*\s*:"
EMOTION = r"\(([^)]+)\)"
EFFECT = r"\*[^*]*\*"
PAUSE_MS = 300


def is_content(line: Column) -> Column:
    """Neither blank nor a comment."""
    trimmed = strip(line)
    return (trimmed != "") & ~trimmed.startswith("#")


def _clean(text: Column) -> Column:
    return strip(F.regexp_replace(text, EFFECT, ""))


def _row(character: Column, text: Column, emotions: Column) -> Column:
    return F.struct(character.alias("character"), text.alias("text"), emotions.alias("emotions"))


def _headed(line: Column) -> Column:
    head = F.regexp_extract(line, HEADER, 0)
    emotions = F.transform(F.regexp_extract_all(head, F.lit(EMOTION), F.lit(1)), strip)
    return F.when(head != "", _row(strip(F.regexp_extract(line, HEADER, 1)), _clean(F.substr(line, F.length(head) + 1)), emotions))


def parse_flexible(line: Column) -> Column:
    """(character, text, emotions) of a line in the first form that applies, or null.

    ``[Name] (a)(b): text``; else ``Name: text`` (not after a bracket); else ``Name said text``; else a quoted passage
    whose speaker is the first capitalised word beside it, or Unknown. Effects between asterisks go; empty text is null.
    """
    line = strip(line)
    none = F.array().cast("array<string>")
    headed = _headed(line)
    colon = F.instr(line, ":")
    named = _row(strip(F.substr(line, F.lit(1), colon - 1)), _clean(F.substr(line, colon + 1)), none)
    said = r"""(?is)\A(["']?)([^"']+)\1\s+said[:\s]*(.+)"""
    told = F.when(line.rlike(said), _row(strip(F.regexp_extract(line, said, 2)), _clean(F.regexp_extract(line, said, 3)), none))
    quote = r'"([^"]*)"'
    beside = F.regexp_replace(line, quote, "")
    speaker = F.regexp_extract(beside, r"\b([A-Z][a-zA-Z]+)\b", 1)
    heard = F.when(line.rlike(quote), _row(F.when(speaker == "", "Unknown").otherwise(speaker), _clean(F.regexp_extract(line, quote, 1)), none))
    found = (
        F.when(headed.isNotNull(), headed)
        .when((colon > 0) & ~line.startswith("["), named)
        .when(F.contains(F.lower(line), F.lit(" said")), told)
        .when(F.contains(line, F.lit('"')), heard)
    )
    return F.when((found["text"] != "") & is_content(line), found)


def parse_script(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` with character, text, emotions of those that parse; comments, blanks and other lines go."""
    return lines.filter(is_content(F.col(line_col))).withColumn("__p", parse_flexible(F.col(line_col))).filter("__p is not null").select("*", "__p.character", "__p.text", "__p.emotions").drop("__p")


def parse_strict(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """As parse_script, for headed lines only; ``speech`` is the text led by its emotions in brackets."""
    rows = lines.filter(is_content(F.col(line_col))).withColumn("__p", _headed(strip(F.col(line_col)))).filter("__p is not null").select("*", "__p.character", "__p.text", "__p.emotions").drop("__p")
    tags = F.array_join(F.transform("emotions", lambda e: F.concat(F.lit("["), e, F.lit("]"))), "")
    return rows.withColumn("speech", strip(F.concat(tags, F.lit(" "), F.col("text"))))


def standard_format(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` with ``standard``: each line in headed form, marked as unparsed if it cannot be, blanks and comments as they are."""
    p = parse_flexible(F.col(line_col))
    return lines.withColumn("standard", F.when(~is_content(F.col(line_col)), F.col(line_col)).when(p.isNull(), F.concat(F.lit("# UNPARSED: "), F.col(line_col))).otherwise(format_line(p["character"], p["emotions"], p["text"])))


def character_usage(parsed: DataFrame) -> DataFrame:
    """(story_id, character, uses)."""
    return parsed.groupBy("story_id", "character").agg(F.count("*").alias("uses"))


def emotion_usage(parsed: DataFrame) -> DataFrame:
    """(story_id, emotion, uses), each occurrence counted."""
    return parsed.select("story_id", F.explode("emotions").alias("emotion")).groupBy("story_id", "emotion").agg(F.count("*").alias("uses"))


def unsupported(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` in use that ``known`` lacks, with their uses over all stories."""
    return used.groupBy(column).agg(F.sum("uses").alias("uses")).join(known.select(column).distinct(), column, "left_anti")


def effect_usage(parsed: DataFrame) -> DataFrame:
    """(story_id, effect, uses): always empty, as effects are taken out of lines and not kept."""
    return parsed.select("story_id", F.lit(None).cast("string").alias("effect"), F.lit(0).cast("long").alias("uses")).filter(F.lit(False))


def teaser_stats(stories: DataFrame, most: int = 5, seconds: int = 3) -> DataFrame:
    """(story_id, lines, fits, seconds): lines of a text that are neither blank nor begin with a comment mark, whether they are few enough, and how long they may take to say."""
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: (strip(x) != "") & ~x.startswith("#"))
    return stories.select("story_id", F.size(kept).alias("lines")).select("story_id", "lines", (F.col("lines") <= most).alias("fits"), (F.col("lines") * seconds).alias("seconds"))


def usage_order(used: DataFrame) -> DataFrame:
    """Usage rows, most used first, then by name."""
    names = [c for c in used.columns if c != "uses"]
    return used.orderBy(F.desc("uses"), *names)


def line_totals(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(story_id, total_lines, parsed_lines): blanks and comments count in the total."""
    return lines.groupBy("story_id").agg(F.count("*").alias("total_lines"), F.count_if(is_content(F.col(line_col)) & parse_flexible(F.col(line_col)).isNotNull()).alias("parsed_lines"))


def merge_usage(*parts: DataFrame) -> DataFrame:
    """Usage tables of parts of the input as that of the whole; associative and commutative."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    keys = [c for c in whole.columns if c != "uses"]
    return whole.groupBy(*keys).agg(F.sum("uses").alias("uses"))


def with_voices(parsed: DataFrame, voices: DataFrame) -> DataFrame:
    """Lines whose character has a voice, with voice_id; ``voices`` is (character, voice_id)."""
    return parsed.join(voices.select("character", "voice_id"), "character")


def without_voices(parsed: DataFrame, voices: DataFrame) -> DataFrame:
    return parsed.join(voices.select("character"), "character", "left_anti")


def speech_sequence(voiced: DataFrame, limit: int = 800) -> DataFrame:
    """(story_id, line_no, part, type, character, voice_id, text, duration): each line's speech, then a pause, the last line's too.

    A speech of more than ``limit`` characters is cut by smart_cuts() into several, with one pause after the last. Only
    such lines leave the JVM.
    """
    null = F.lit(None).cast("string")
    speech = lambda text: F.struct(F.lit("speech").alias("type"), F.col("character"), F.col("voice_id"), text.alias("text"), F.lit(None).cast("int").alias("duration"))
    pause = F.struct(F.lit("pause").alias("type"), null.alias("character"), null.alias("voice_id"), null.alias("text"), F.lit(PAUSE_MS).alias("duration"))
    long = F.length("text") > limit
    short = voiced.filter(~F.coalesce(long, F.lit(False))).select("story_id", "line_no", "character", "voice_id", F.array("text").alias("pieces"))
    cut = voiced.filter(long).select("story_id", "line_no", "character", "voice_id", smart_cuts(F.col("text"), limit).alias("pieces"))
    entries = F.concat(F.transform("pieces", speech), F.array(pause))
    return short.unionByName(cut).select("story_id", "line_no", F.posexplode(entries).alias("part", "x")).select("story_id", "line_no", "part", "x.*")


def with_ids(lines: DataFrame) -> DataFrame:
    """``lines`` with id ``line_<n>`` by their 0-based line_no, given before any filter."""
    return lines.withColumn("id", F.concat(F.lit("line_"), (F.col("line_no") + 1).cast("string")))


def spoken(lines: DataFrame, include_narration: bool) -> DataFrame:
    return lines if include_narration else lines.filter(F.coalesce(F.col("type"), F.lit("")) != "narration")


def resolve_ambiguous(lines: DataFrame, choices: DataFrame) -> DataFrame:
    """Ambiguous lines take their choice (story_id, id, choice, custom), then its custom name; others stay."""
    met = lines.join(choices.select("story_id", "id", "choice", "custom"), ["story_id", "id"], "left")
    picked = F.coalesce(F.nullif("choice", F.lit("")), F.nullif("custom", F.lit("")), F.col("character"))
    return met.withColumn("character", F.when(F.col("character") == "Ambiguous", picked).otherwise(F.col("character"))).drop("choice", "custom")


def story_summary(lines: DataFrame) -> DataFrame:
    """(story_id, raw_line_count, dialogue_count, has_ambiguity, characters)."""
    return lines.groupBy("story_id").agg(F.count("*").alias("raw_line_count"), F.count_if(F.col("type") != "narration").alias("dialogue_count"), F.bool_or(F.col("character") == "Ambiguous").alias("has_ambiguity"), F.countDistinct("character").alias("characters"))


def formatted_script(lines: DataFrame) -> DataFrame:
    """(story_id, script): formatted lines in order, one text per story."""
    row = F.struct("line_no", format_line(F.col("character"), F.col("emotions"), F.col("text")).alias("line"))
    return lines.groupBy("story_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("story_id", F.array_join(F.col("rows.line"), "\n").alias("script"))


def timeline(sequence: DataFrame, pad_ms: int = 250) -> DataFrame:
    """``sequence`` with start_ms: durations before it, and a pad after each entry but the last that no pause follows."""
    from pyspark.sql import Window as W

    order = W.partitionBy("story_id").orderBy("line_no", "part")
    pad = F.when((F.lead("type").over(order).isNotNull()) & (F.lead("type").over(order) != "pause"), pad_ms).otherwise(0)
    padded = sequence.withColumn("__span", F.coalesce("duration", F.lit(0)) + pad)
    return padded.withColumn("start_ms", F.coalesce(F.sum("__span").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__span")
