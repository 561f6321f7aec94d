"""Chunks of text: greedy packing, cursor cuts and fixed windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import bind, rows_of, strip


def fixed_windows(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters; none of an empty text."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_text(docs: DataFrame, id_col: str = "project_id", text_col: str = "text", most: int = 2000) -> DataFrame:
    """(project_id, idx, id, text): paragraphs packed greedily up to ``most`` characters, else their sentences, else hard cuts.

    An ordered fold over each text's pieces in ``aggregate``: the state is the chunks so far and the open one. A blank
    text, not an empty one, is one attempt that yields nothing.
    """
    pieces = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n{2,}"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(done: Column, now: Column) -> Column:
        return F.struct(done.alias("done"), now.alias("open"))

    def sentence(a: Column, s: Column) -> Column:
        closed = F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        return (
            F.when(F.length(s) > most, pack(F.concat(closed, fixed_windows(s, most)), F.lit("")))
            .when(a["open"] == "", pack(a["done"], s))
            .when(F.length(a["open"]) + 1 + F.length(s) <= most, pack(a["done"], F.concat(a["open"], F.lit(" "), s)))
            .otherwise(pack(closed, s))
        )

    def paragraph(a: Column, p: Column) -> Column:
        gap = F.when(a["open"] != "", 2).otherwise(0)
        whole = (F.length(p) <= most) & (F.length(a["open"]) + F.length(p) + gap <= most)
        sentences = F.filter(F.transform(F.split(p, r"(?<=[.!?])(?U)\s+"), strip), lambda s: s != "")
        spaced = lambda b: F.when((b["open"] != "") & (F.length(b["open"]) + 2 <= most), F.concat(b["open"], F.lit("\n\n"))).otherwise(b["open"])
        by_sentence = bind(F.aggregate(sentences, a, sentence), lambda b: pack(b["done"], spaced(b)))
        return F.when(whole, pack(a["done"], F.when(a["open"] != "", F.concat(a["open"], F.lit("\n\n"), p)).otherwise(p))).otherwise(by_sentence)

    last = lambda a: F.when(strip(a["open"]) != "", F.concat(a["done"], F.array(strip(a["open"])))).otherwise(a["done"])
    numbered = bind(F.aggregate(pieces, start, paragraph, last), lambda chunks: F.transform(chunks, lambda c: F.struct(F.size(chunks).alias("n"), c.alias("text"))))
    rows = rows_of(docs.withColumn("__id", F.col(id_col)), numbered, "idx", "__id").select(F.col("__id").alias("project_id"), "idx", "x.*")
    number = F.expr("lpad(cast(idx + 1 as string), greatest(3, length(cast(n as string))), '0')")
    return rows.select("project_id", "idx", F.concat(F.col("project_id").cast("string"), F.lit("_chunk"), number).alias("id"), "text")


def smart_pieces(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut after the last full stop of a window if it lies in its last two fifths."""
    out, at, n, least = [], 0, len(text), int(limit * 0.6)
    if n <= limit:
        return [text]
    while n - at > limit:
        dot = text.rfind(".", at, at + limit) - at
        step = dot + 1 if dot >= least else limit
        piece = text[at : at + step].strip()
        if not piece:
            step, piece = limit, text[at : at + limit]
        out.append(piece)
        at += step
    if at < n:
        out.append(text[at:])
    return out


def smart_cuts(text: Column, limit: int) -> Column:
    """smart_pieces() of the stripped text; a text that fits is one piece, even if empty.

    The cursor depends on the data, so this is a loop over slices in an Arrow batch.
    """

    @F.pandas_udf("array<string>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: smart_pieces((t or "").strip(), limit))

    return cuts(F.coalesce(text, F.lit("")))


def cursor_cuts(docs: DataFrame, id_col: str = "project_id", text_col: str = "text", limit: int = 200) -> DataFrame:
    """(project_id, idx, text): the smart_cuts() of each text."""
    return docs.select(F.col(id_col).alias("project_id"), F.posexplode(smart_cuts(F.col(text_col), limit)).alias("idx", "text"))


def piece_metrics(pieces: DataFrame) -> DataFrame:
    """(project_id, pieces, avg_chars) of chunks or cuts; the mean is null for none."""
    return pieces.groupBy("project_id").agg(F.count("*").alias("pieces"), F.avg(F.length("text")).alias("avg_chars"))


def chunk_tasks(docs: DataFrame, voices: DataFrame, size: int = 200, id_col: str = "project_id", text_col: str = "text", default_voice: str = "") -> DataFrame:
    """(project_id, line_no, part, text, voice_id): windows of each line that is neither blank nor a comment, with the voice its prefix names."""
    lines = docs.select(F.col(id_col).alias("project_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", strip("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    name = F.coalesce(F.nullif(F.regexp_extract("line", r"\A\[([^\]]+)\]", 1), F.lit("")), F.regexp_extract("line", r"\A([^:\[\]]+):", 1))
    met = lines.withColumn("__key", F.lower(strip(name))).join(voices.select(F.lower("character").alias("__key"), "voice_id"), "__key", "left")
    return met.select("project_id", "line_no", F.posexplode(fixed_windows(F.col("line"), size)).alias("part", "text"), F.coalesce("voice_id", F.lit(default_voice)).alias("voice_id"))
