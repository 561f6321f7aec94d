"""Sinks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines_json(lines: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append one JSON object per line, in a folder of the run."""
    lines.withColumn("run_id", F.lit(run_id or uuid4().hex[:8])).write.mode("append").partitionBy("run_id").json(path)


def write_scripts(scripts: DataFrame, path: str, buckets: int = 64) -> None:
    """Formatted scripts as JSON lines (story_id, script), in ``buckets`` folders by a hash of the story, however many stories there are."""
    named = scripts.select("story_id", "script", F.pmod(F.xxhash64("story_id"), F.lit(buckets)).alias("bucket"))
    named.write.mode("overwrite").partitionBy("bucket").json(path)


def write_history(runs: DataFrame, path: str) -> None:
    """One JSON document per run, nested lines and all."""
    runs.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def readable_log(lines: DataFrame) -> DataFrame:
    """(story_id, line_no, value): ``NN. [TYPE] text``, and last, as line_no null, how many lines there are of each type."""
    each = lines.select("story_id", "line_no", F.format_string("%02d. [%s] %s", F.col("line_no") + 1, F.upper("type"), F.col("text")).alias("value"))
    counts = lines.groupBy("story_id", "type").agg(F.count("*").alias("n")).groupBy("story_id").agg(F.sort_array(F.collect_list(F.concat(F.upper("type"), F.lit(": "), F.col("n").cast("string")))).alias("counts"), F.sum("n").alias("total"))
    return each.unionByName(counts.select("story_id", F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no"), F.format_string("%d lines. %s", F.col("total"), F.array_join("counts", ", ")).alias("value")))


def write_voice_mappings(mappings: DataFrame, path: str) -> None:
    """(project, character, voice_id) as JSON objects {project_name, created_date, voice_mappings}, a line per project."""
    saved = mappings.filter("project is not null and character is not null").groupBy("project", "character").agg(F.min("voice_id").alias("voice_id"))
    rows = saved.groupBy(F.col("project").alias("project_name")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("character", "voice_id")))).alias("voice_mappings"))
    rows.select("project_name", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"), "voice_mappings").write.mode("overwrite").json(path)


def remove_objects(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """``objects`` (key, ...) without the keys of ``gone``; a key that is not there is no error."""
    return objects.join(gone.select("key").distinct(), "key", "left_anti")


def put_objects(objects: DataFrame, fresh: DataFrame) -> DataFrame:
    """``objects`` with those of ``fresh`` in place of their keys; both (key, ...) alike."""
    return remove_objects(objects, fresh).unionByName(fresh)


def append_names(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Names of ``fresh`` that ``known`` lacks, ignoring case, each once."""
    low = F.lower(F.trim("name"))
    first = fresh.filter(F.trim("name") != "").groupBy(low.alias("__low")).agg(F.min("name").alias("name"))
    return first.join(known.select(low.alias("__low")).distinct(), "__low", "left_anti").select("name")
