"""Sources as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.sources.pdf import page_texts, unicode_map

#: Characters of an upload that are kept, and the line that marks a cut.
INGEST_LIMIT, INGEST_MARK = 100_000, "\n# [text truncated]"
CATALOG_SCHEMA = "map<string, map<string, struct<voice_id: string, gender: string>>>"


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per UTF-8 file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decode_text(content: Column) -> Column:
    """UTF-8 bytes as text, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What stands in a run of a DOCX paragraph besides its text.
_IN_RUN = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}


def _docx_blocks(parent: ElementTree.Element) -> Iterator[str]:
    """Paragraphs and rows of tables, in order; cells are parted by tabs, a cell's own blocks by blanks."""
    for x in parent:
        if x.tag == f"{_WORD}p":
            yield "".join(t.text or "" if t.tag == f"{_WORD}t" else _IN_RUN.get(t.tag, "") for r in x.iter(f"{_WORD}r") for t in r)
        elif x.tag == f"{_WORD}tbl":
            for row in x.iterfind(f"{_WORD}tr"):
                yield "\t".join(" ".join(_docx_blocks(cell)) for cell in row.iterfind(f"{_WORD}tc"))
        elif x.tag in (f"{_WORD}sdt", f"{_WORD}sdtContent"):
            yield from _docx_blocks(x)


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        document = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join(_docx_blocks(document.find(f"{_WORD}body")))


def _pdf(content: bytes) -> list[str]:
    """The pages of a PDF file; if no page tree is left, what all its streams show, as one."""
    return page_texts(content) or [_pdf_streams(content)]


def _pdf_streams(content: bytes) -> str:
    """Text operators of a broken file's streams, a line each: plain strings as Latin-1, hexadecimal ones by all fonts' maps to Unicode."""
    streams = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            streams.append(zlib.decompress(stream))
        except zlib.error:
            streams.append(stream)
    known: dict[bytes, str] = {}
    for stream in streams:
        known |= unicode_map(stream)[0]
    wide = max((len(c) for c in known), default=1)

    def shown(token: bytes) -> str:
        if token.startswith(b"("):
            return re.sub(rb"\\(.)", rb"\1", token[1:-1]).decode("latin-1")
        raw = bytes.fromhex(token[1:-1].decode().ljust(len(token) - 2 + (len(token) & 1), "0"))
        return "".join(known.get(raw[k : k + wide], "") for k in range(0, len(raw), wide)) if known else raw.decode("latin-1")

    one = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f]*>"
    pages = []
    for stream in streams:
        found = re.findall(rb"(" + one + rb")\s*(?:Tj|'|\")|\[((?:" + one + rb"|[^\]()<>])*)\]\s*TJ", stream)
        line = [shown(a) if a else "".join(shown(t) for t in re.findall(one, b)) for a, b in found]
        if line:
            pages.append(" ".join(line))
    return "\n".join(pages)


def file_kind(path: Column, mime: Column | None = None) -> Column:
    """docx, pdf or txt, by the declared type, if one is known, or the extension; anything else is text."""
    low, told = F.lower(path), F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    is_text = (told == "text/plain") | low.endswith(".txt")
    docx = (told == "application/vnd.openxmlformats-officedocument.wordprocessingml.document") | low.endswith(".docx")
    return F.when(is_text, "txt").when(docx, "docx").when((told == "application/pdf") | low.endswith(".pdf"), "pdf").otherwise("txt")


def extract_documents(spark: SparkSession, path: str, types: DataFrame | None = None) -> DataFrame:
    """(path, text, error) of text, DOCX and PDF files, told apart by file_kind(); ``types``: (path, mime) where types are declared.

    A file that its reader rejects has printable characters as text and the reason in ``error``. Pages are joined by newlines.
    """
    pages = read_pages(spark, path, types)
    held = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])  # as many as its one file holds
    return pages.groupBy("path").agg(F.array_join(held, "\n").alias("text"), F.max("error").alias("error"))


def read_pages(spark: SparkSession, path: str, types: DataFrame | None = None) -> DataFrame:
    """(path, page, text, error): a row for each page of the PDF files below ``path``, one for any other file; pages count from 1.

    Spark reads and deals the files, wherever they lie; a file is one task's. Files without a byte give no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("mime", F.lit(None).cast("string")) if types is None else files.join(types.select("path", "mime"), "path", "left")
    files = files.withColumn("kind", file_kind(F.col("path"), F.col("mime")))

    @F.pandas_udf("struct<pages: array<string>, error: string>")
    def office(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(kind: str, content: bytes) -> tuple[list[str], str | None]:
            try:
                return _pdf(content) if kind == "pdf" else [_docx(content)], None
            except Exception as e:  # a broken file is data, not a failure of the job
                return [re.sub(r"[^\x20-\x7E\n\r\t]", "", content.decode("utf-8", "ignore"))], f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(k, c) for k, c in zip(kinds, contents)], columns=["pages", "error"])

    plain = files.filter("kind = 'txt'").select("path", F.lit(1).alias("page"), decode_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    read = files.filter("kind <> 'txt'").select("path", office("kind", "content").alias("x")).select("path", F.posexplode("x.pages").alias("page", "text"), "x.error")
    return plain.unionByName(read.select("path", (F.col("page") + 1).alias("page"), "text", "error"))


def bounded(text: Column, limit: int = INGEST_LIMIT) -> Column:
    """At most ``limit`` characters, with a mark where more were there."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(INGEST_MARK))).otherwise(text)


def read_config(spark: SparkSession, schema: str, *paths: str, empty: str = "{}") -> DataFrame:
    """One row (value), the JSON of the first path that exists and parses by ``schema``; that of ``empty`` if none does."""
    for path in paths:
        try:
            found = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value")).filter("value is not null")
            if not found.isEmpty():
                return found.limit(1)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.range(1).select(F.from_json(F.lit(empty), schema).alias("value"))


def read_catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """One row (groups) of the first path that exists and parses; an empty map if none does."""
    return read_config(spark, CATALOG_SCHEMA, *paths).withColumnRenamed("value", "groups")


def read_tags(spark: SparkSession, *paths: str) -> DataFrame:
    """(category, emotion, tag) of a JSON object category -> name -> tag."""
    return read_config(spark, "map<string, map<string, string>>", *paths).select(F.explode("value").alias("category", "names")).select("category", F.explode("names").alias("emotion", "tag"))


def read_words(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, word) of a JSON list."""
    return read_config(spark, "array<string>", *paths, empty="[]").select(F.posexplode("value").alias("ord", "word"))


def read_word_map(spark: SparkSession, *paths: str) -> DataFrame:
    """(word, value) of a JSON object of words."""
    return read_config(spark, "map<string, string>", *paths).select(F.explode("value").alias("word", "value"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): distinct lower-cased lines."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("name")).filter("name <> ''").distinct()


def read_voice_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(project, character, voice_id), of JSON lines {project_name, voice_mappings} or a file with such an object for each project."""
    raw = spark.read.schema("project_name string, voice_mappings map<string, string>").json(path, multiLine=path.rstrip("/").endswith("_voices.json"))
    return raw.filter("voice_mappings is not null").select(F.col("project_name").alias("project"), F.explode("voice_mappings").alias("character", "voice_id"))


def get_objects(asked: DataFrame, objects: DataFrame, schema: str) -> DataFrame:
    """``asked`` (key, ...) with ``data``, the parsed JSON of the object (key, body) of that key; null if it is missing or broken."""
    return asked.join(objects.select("key", F.from_json("body", schema).alias("data")), "key", "left")


def existing(asked: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of ``asked`` whose key the listing has; no content is read."""
    return asked.join(listing.select("key").distinct(), "key", "left_semi")


def list_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(key, last_modified) of the files below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), F.col("modificationTime").alias("last_modified"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line): plain or gzipped log lines."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def model_cast(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(story_id, ord, name, gender) of a model's JSON answers {"characters": [{name, gender}]}, names once ignoring case."""
    found = payloads.select("story_id", F.posexplode(F.from_json(column, "struct<characters: array<struct<name: string, gender: string>>>")["characters"]).alias("ord", "c"))
    named = found.select("story_id", "ord", F.trim("c.name").alias("name"), F.col("c.gender").alias("gender")).filter("name <> ''")
    return named.groupBy("story_id", F.lower("name").alias("__low")).agg(F.min(F.struct("ord", "name", "gender")).alias("c")).select("story_id", "c.*")
