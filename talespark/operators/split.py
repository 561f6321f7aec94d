"""Prose to lines: soft wraps, quote-toggled segments, sentences, attributions. All within a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import bind, one_line, rows_of, strip

#: Verbs that mark a sentence after speech as its attribution, and the sentence pattern.
ATTRIBUTION_VERBS = "said|asked|whispered|murmured|shouted|replied|called|answered|cried|laughed|sobbed|muttered"
SENTENCE = r"([^.!?]*[.!?])"


def looks_like_attribution(c: Column) -> Column:
    return c.rlike(rf"(?iU)\b({ATTRIBUTION_VERBS})\b") | c.rlike(r"(?iU)\b(he|she)\b\s+\w+")


def paragraphs(stories: DataFrame, id_col: str = "story_id", text_col: str = "text") -> DataFrame:
    """(story_id, paras): soft-wrapped lines joined. A line goes on from the one before if that ends without closing
    punctuation and this begins in lower case, or if this begins with anything but a letter; a blank line ends a paragraph.
    Null and blank stories have no paragraphs. U+0001 counts as a blank.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\x01", " ")
    physical = F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))

    def mark(x: Column, back: Column) -> Column:
        goes_on = (back != "") & ((~back.rlike(r'[.!?"”]\z') & x.rlike(r"\A\p{Ll}")) | ~x.rlike(r"\A\p{L}"))
        return F.when(x == "", "\x01").when(goes_on, F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit("\x01"), x))

    joined = bind(physical, lambda lines: F.array_join(F.transform(lines, lambda x, i: mark(x, F.coalesce(F.get(lines, i - 1), F.lit("")))), ""))
    return stories.select(F.col(id_col).alias("story_id"), F.filter(F.transform(F.split(joined, "\x01"), strip), lambda p: p != "").alias("paras"))


def split_lines(stories: DataFrame, id_col: str = "story_id", text_col: str = "text") -> DataFrame:
    """(story_id, line_no, text, type, raw, attribution): speech between double quotes, sentences of narration elsewhere.

    Quotes toggle within a paragraph; an unclosed one runs to its end. Narration without a final mark is dropped. A
    sentence that looks like an attribution right after speech is also attached to that speech.
    """
    def lines_of(para: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            speech = F.filter(F.array(strip(p)), lambda t: t != "")
            told = F.filter(F.transform(F.regexp_extract_all(strip(p), F.lit(SENTENCE), F.lit(1)), strip), lambda t: t != "")
            row = lambda kind: lambda t: F.struct(t.alias("text"), F.lit(kind).alias("type"), para.alias("raw"))
            return F.when(i % 2 == 1, F.transform(speech, row("dialogue"))).otherwise(F.transform(told, row("narration")))

        return F.flatten(F.transform(F.split(one_line(para), '"'), piece))

    def attach(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.get(found, i + 1)
            said = F.when((x["type"] == "dialogue") & (after["type"] == "narration") & looks_like_attribution(after["text"]), after["text"])
            return F.struct(x["text"].alias("text"), x["type"].alias("type"), x["raw"].alias("raw"), said.alias("attribution"))

        return F.transform(found, one)

    told = bind(F.flatten(F.transform("paras", lines_of)), attach)
    return rows_of(paragraphs(stories, id_col, text_col), told, "line_no", "story_id").select("story_id", "line_no", "x.*")


def line_type_counts(lines: DataFrame) -> DataFrame:
    """(story_id, dialogue, narration, total)."""
    return lines.groupBy("story_id").agg(F.count_if(F.col("type") == "dialogue").alias("dialogue"), F.count_if(F.col("type") == "narration").alias("narration"), F.count("*").alias("total"))
