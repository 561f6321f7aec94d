"""Session logs: parsing, level counts, memory, retention, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("INFO", "DEBUG", "ERROR", "DIAG", "UI")
LINE = r"\A\[([^\]]*?) UTC\] \[([A-Z]+)\](?:\[([^\]]*)\])? ?(.*)\z"


def parse_log(raw: DataFrame, column: str = "value") -> DataFrame:
    """``raw`` with ts, level, source, message of each log line; nulls where a line is not one."""
    part = lambda k: F.nullif(F.regexp_extract(column, LINE, k), F.lit(""))
    return raw.withColumns({"ts": F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")), "level": part(2), "source": part(3), "message": part(4)})


def log_summary(raw: DataFrame, column: str = "line") -> DataFrame:
    """One row: lines that carry each level's mark, error lines, and the mean memory of diagnostic lines."""
    has = lambda level: F.count_if(F.contains(column, F.lit(f"[{level}]")))
    memory = F.when(F.contains(column, F.lit("[DIAG]")), F.expr(f"try_cast(nullif(regexp_extract({column}, 'Memory usage: ([0-9.]+)', 1), '') as double)"))
    return raw.agg(*(has(level).alias(level.lower()) for level in LEVELS), F.round(F.avg(memory), 2).alias("avg_memory"))


def error_lines(raw: DataFrame, column: str = "line") -> DataFrame:
    return raw.filter(F.contains(column, F.lit("[ERROR]")))


def retention(files: DataFrame, keep: int = 25, compress_days: int = 3, now: str | None = None) -> DataFrame:
    """``files`` (project, key, last_modified) with action: delete beyond the newest ``keep`` of a project, compress old ones, else keep."""
    place = F.row_number().over(W.partitionBy("project").orderBy(F.desc("last_modified"), F.desc("key")))
    age = F.date_diff(F.lit(now).cast("timestamp") if now else F.current_timestamp(), F.col("last_modified"))
    old = (age >= compress_days) & ~F.col("key").endswith(".gz")
    return files.withColumn("place", place).withColumn("action", F.when(F.col("place") > keep, "delete").when(old, "compress").otherwise("keep"))


def page(files: DataFrame, number: int, size: int = 10, suffix: str = ".json") -> DataFrame:
    """Page ``number`` (from 0) of the keys with ``suffix``, newest first over all."""
    return files.filter(F.col("key").endswith(suffix)).orderBy(F.desc_nulls_last("last_modified"), "key").offset(number * size).limit(size)


def resumable_session(files: DataFrame, now: str, minutes: int = 10, top: int = 3) -> DataFrame:
    """The newest of the ``top`` newest logs that is at most ``minutes`` old and not compressed: a row or none."""
    newest = files.orderBy(F.desc("last_modified"), F.desc("key")).limit(top)
    fresh = F.col("last_modified") >= F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes")
    return newest.filter(fresh & ~F.col("key").endswith(".gz")).orderBy(F.desc("last_modified"), F.desc("key")).limit(1)


def python_dict_fields(raw: DataFrame, schema: str, column: str = "message") -> DataFrame:
    """``raw`` with ``fields``, parsed from the printed form of a dict: single quotes, None, True and False."""
    text = F.col(column)
    for odd, plain in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false")):
        text = F.regexp_replace(text, odd, plain)
    return raw.withColumn("fields", F.from_json(text, schema, {"allowSingleQuotes": "true"}))


def log_line(ts: Column, level: Column, message: Column, source: Column | None = None) -> Column:
    """A human-readable line: ``[time UTC] [LEVEL][source] message``; no mark of a source where it is null or empty."""
    mark = F.lit("") if source is None else F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("["), source, F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC] ["), F.upper(F.coalesce(level, F.lit(""))), F.lit("]"), mark, F.lit(" "), message)


def error_rows(kind: Column, message: Column, trace: Column) -> Column:
    """The lines an exception leaves: its kind and message at level ERROR, then its trace, line by line, as array<struct<level, message>>."""
    row = lambda level, text: F.struct(level.alias("level"), text.alias("message"))
    traced = F.transform(F.filter(F.split(F.coalesce(trace, F.lit("")), "\n"), lambda t: t != ""), lambda t: row(F.lit(None).cast("string"), t))
    return F.concat(F.array(row(F.lit("ERROR"), F.concat_ws(": ", kind, message))), traced)


def structured_line(fields: dict[str, Column]) -> Column:
    """A structured line, ``[JSON] {...}``, of the given fields; nulls are written."""
    return F.concat(F.lit("[JSON] "), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}))


def named_like(files: DataFrame, date: str = "", part: str = "") -> DataFrame:
    """``files`` whose key contains ``date`` as it is and ``part`` in any case; empty ones are no condition."""
    kept = files.filter(F.contains("key", F.lit(date))) if date else files
    return kept.filter(F.contains(F.lower("key"), F.lit(part.lower()))) if part else kept


def log_page(files: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 0) of the keys in reverse lexical order over all."""
    return files.orderBy(F.desc("key")).offset(number * size).limit(size)


def recent(files: DataFrame, k: int = 20, suffix: str = ".json") -> DataFrame:
    """The ``k`` newest keys with ``suffix``, over all keys."""
    return page(files, 0, k, suffix)


def history(entries: DataFrame, column: str = "last_updated") -> DataFrame:
    """``entries`` newest first by their written time, those whose time does not parse last; with ``updated``, the parsed time."""
    return entries.withColumn("updated", F.try_to_timestamp(column, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).orderBy(F.desc_nulls_last("updated"), "project_id")
