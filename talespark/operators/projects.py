"""Project state: chunk statuses, commit index, pending work, voice settings and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import clamp01, first_given, nearest_level

#: Voice settings where none are given.
DEFAULTS = {"stability": 0.5, "similarity_boost": 0.75, "style": 0.0}


def mark_done(state: DataFrame, done: DataFrame) -> DataFrame:
    """``state`` (project_id, idx, status, ...) with the status of every row of ``done`` (project_id, idx) DONE."""
    hits = done.select("project_id", "idx").distinct().withColumn("__hit", F.lit(True))
    return state.join(hits, ["project_id", "idx"], "left").withColumn("status", F.when(F.col("__hit"), "DONE").otherwise(F.col("status"))).drop("__hit")


def pending(state: DataFrame) -> DataFrame:
    """Chunks that are not done and lie beyond their project's committed index."""
    return state.filter((F.col("status") != "DONE") & (F.col("idx") > F.coalesce("committed_index", F.lit(-1))))


def committed_index(state: DataFrame, objects: DataFrame) -> DataFrame:
    """(project_id, committed_index): the larger of the state's and the published object's index; -1 without either."""
    both = state.select("project_id", "committed_index").unionByName(objects.select("project_id", "committed_index"))
    return both.groupBy("project_id").agg(F.coalesce(F.max("committed_index"), F.lit(-1)).alias("committed_index"))


def commit_points(entries: DataFrame, every: int = 5) -> DataFrame:
    """(project_id, idx): entries after which a run commits, each ``every``-th and the last."""
    last = entries.groupBy("project_id").agg(F.max("idx").alias("__last"))
    return entries.join(last, "project_id").filter(((F.col("idx") + 1) % every == 0) | (F.col("idx") == F.col("__last"))).select("project_id", "idx")


def upsert_state(state: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("project_id", "idx")) -> DataFrame:
    """``fresh`` rows, and those of ``state`` whose keys it lacks."""
    return state.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def voice_settings(rows: DataFrame) -> DataFrame:
    """``rows`` with stability and style at their nearest level and similarity within 0 and 1, defaults for nulls."""
    value = {k: clamp01(F.coalesce(F.col(k).cast("double"), F.lit(v))) for k, v in DEFAULTS.items()}
    return rows.withColumns({"stability": nearest_level(value["stability"]), "similarity_boost": value["similarity_boost"], "style": nearest_level(value["style"])})


def overlay_voices(entries: DataFrame, working: DataFrame) -> DataFrame:
    """``entries`` with the working voice of their character by exact, else by lower-case name, else their own voice_id."""
    exact = working.select("character", F.col("voice_id").alias("__exact"))
    loose = working.groupBy(F.lower("character").alias("__low")).agg(F.min("voice_id").alias("__loose"))
    met = entries.join(exact, "character", "left").withColumn("__low", F.lower("character")).join(loose, "__low", "left")
    return met.withColumn("voice_id", F.coalesce("__exact", "__loose", "voice_id")).drop("__exact", "__loose", "__low")


def default_voice(voices: DataFrame, override: str | None = None) -> DataFrame:
    """One row (voice_id): the override, else the narrator's voice, else the first by name, else an empty one."""
    known = voices.filter("voice_id is not null and voice_id <> ''")
    narrator = F.min(F.when(F.lower("character") == "narrator", F.col("voice_id")))
    first = F.min(F.struct("character", "voice_id"))["voice_id"]
    return known.agg(F.coalesce(F.lit(override), narrator, first, F.lit("")).alias("voice_id"))


def voice_descriptions(entries: DataFrame, described: DataFrame) -> DataFrame:
    """``entries`` with the description of their voice, by (voice_id, description)."""
    first = described.groupBy("voice_id").agg(F.min("description").alias("description"))
    return entries.join(first, "voice_id", "left").withColumn("description", F.coalesce("description", F.lit("Custom voice assignment")))


def voice_assignments(maps: list[DataFrame], catalog: DataFrame) -> DataFrame:
    """(character, voice_id) of the first of ``maps`` that has rows, else of the catalog's entries (display, voice_id) that have a voice.

    All of it is one plan: each source's rows carry its place, and the least place present stays.
    """
    own = [m.select("character", "voice_id", F.lit(k).alias("place")) for k, m in enumerate(maps)]
    fallback = catalog.filter("voice_id is not null and voice_id <> ''").select(F.col("display").alias("character"), "voice_id", F.lit(len(maps)).alias("place"))
    every = fallback
    for m in own:
        every = every.unionByName(m)
    first = every.agg(F.min("place").alias("place"))  # one row
    return every.join(F.broadcast(first), "place").select("character", "voice_id")


def project_names(rows: DataFrame, columns: list[str], default: str = "global") -> DataFrame:
    """``rows`` with ``project``: the first of ``columns`` that is neither null nor empty, else the default."""
    return rows.withColumn("project", F.coalesce(first_given(*map(F.col, columns)), F.lit(default)))


def project_settings(projects: DataFrame, saved: DataFrame) -> DataFrame:
    """``projects`` (project_id) with voice_settings() of what is saved for them, defaults where nothing is."""
    return voice_settings(projects.join(saved.select("project_id", *DEFAULTS), "project_id", "left"))
