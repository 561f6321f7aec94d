"""Text, name and value normalisation as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that the reading side treats as one plain quote, apostrophe or dash (fixed values).
DOUBLE_QUOTES = "“”„‟″"
SINGLE_QUOTES = "‘’‚‛′"
DASHES = "–—"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` reads it.

    An expression that a lambda reads more than once is otherwise computed as often, for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def rows_of(df: DataFrame, array: Column, number: str, *keep: str) -> DataFrame:
    """``keep`` columns, the 0-based ``number`` and ``x`` of each element of ``array``.

    An outer explosion: with an inner one the optimiser also filters by the array's size, which computes it twice. Elements are not null.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(number, "x")).filter("x is not null")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def plain_punctuation(c: Column) -> Column:
    """Typographic quotes, primes, dashes and the ellipsis as ASCII."""
    odd = DOUBLE_QUOTES + SINGLE_QUOTES + DASHES
    even = '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES)
    return F.replace(F.translate(c, odd, even), F.lit("…"), F.lit("..."))


def one_line(c: Column) -> Column:
    """Curly quotes straight, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, "“”‘’", "\"\"''"), r"(?U)\s+", " "))


def normalize_name(c: Column) -> Column:
    """The join key of a name: lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[()\[\].,'\"!?-]+", " "), r"(?U)\s+", " "))


def display_name(c: Column) -> Column:
    """Upper-case first letter of each part between blanks or hyphens; the rest of a part stays."""
    parts = F.regexp_extract_all(c, F.lit(r"([\s-]*[^\s-]+|[\s-]+\z)"), F.lit(1))
    lift = lambda p: F.concat(F.regexp_extract(p, r"\A[\s-]*", 0), F.upper(F.regexp_extract(p, r"\A[\s-]*([^\s-]?)", 1)), F.regexp_extract(p, r"\A[\s-]*[^\s-]?(.*)\z", 1))
    return F.array_join(F.transform(parts, lift), "")


def cast_name(c: Column) -> Column:
    """A cast entry's name without surrounding or double blanks and without a trailing gender word."""
    return strip(F.regexp_replace(strip(F.regexp_replace(c, r"(?U)\s+", " ")), r"(?i)[\s\-,:]+(male|female|man|woman)\s*$", ""))


def candidate_key(c: Column) -> Column:
    """Lower-case ASCII letters of a candidate phrase, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))


def file_name(c: Column) -> Column:
    """A name that is safe in a path: word characters, with runs of blanks and hyphens as underscores."""
    return F.regexp_replace(strip(F.regexp_replace(c, r"(?U)[^\w\s-]", "")), r"(?U)[-\s]+", "_")


def gender_letter(c: Column) -> Column:
    """M, F or U by the first letter of a hint."""
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(up.startswith("M"), "M").when(up.startswith("F"), "F").otherwise("U")


def gender_label(c: Column) -> Column:
    """male, female, nonbinary or unknown, from common spellings."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("m", "male", "man", "boy"), "male").when(low.isin("f", "female", "woman", "girl"), "female").when(low.isin("nb", "nonbinary", "non-binary", "enby"), "nonbinary").otherwise("unknown")


def format_line(character: Column, emotions: Column, text: Column) -> Column:
    """``[character] (a)(b): text``; no emotions stand for soft and calm."""
    known = F.filter(F.coalesce(emotions, F.array().cast("array<string>")), lambda e: e != "")
    known = F.when(F.size(known) == 0, F.array(F.lit("soft"), F.lit("calm"))).otherwise(known)
    marks = F.array_join(F.transform(known, lambda e: F.concat(F.lit("("), e, F.lit(")"))), "")
    return F.regexp_replace(F.concat(F.lit("["), character, F.lit("] "), marks, F.lit(": "), text), r"(?U)\s+\z", "")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def nearest_level(c: Column, levels: tuple[float, ...] = (0.0, 0.5, 1.0)) -> Column:
    """The level closest to ``c``; the first of two that are as close."""
    ranked = [F.struct(F.abs(c - v).alias("off"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(levels)]
    return F.when(c.isNotNull(), F.array_min(F.array(*ranked))["v"])


def preview(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def parse_time(c: Column) -> Column:
    """A timestamp in any of the four written forms; the earliest representable one if none fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH-mm-ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd_HH-mm-ss")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def show_time(c: Column) -> Column:
    """A timestamp as in ``Mar 05, 2024, 04:07 PM``."""
    return F.date_format(c, "MMM dd, yyyy, hh:mm a")


def text_digest(c: Column) -> Column:
    """SHA-1 of the stripped text: equal digests mean that a text has not changed. Null for blank texts."""
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(text != "", F.sha1(text))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty, or null."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def canonical(c: Column) -> Column:
    """First letter upper, the rest lower case: how a name is shown that no catalog knows."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def response_text(output: Column) -> Column:
    """The texts of a model's answer, array<struct<content: array<struct<text: struct<value: string>>>>>, empty ones left out, by line."""
    values = F.flatten(F.transform(F.coalesce(output, F.array().cast("array<struct<content:array<struct<text:struct<value:string>>>>>")), lambda o: F.coalesce(F.transform(o["content"], lambda p: p["text"]["value"]), F.array().cast("array<string>"))))
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), "\n")
