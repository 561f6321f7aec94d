"""Prose to canonical lines, scripts to analyses, scripts to speech sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talespark.operators import emotions, scripts, speaker_blocks, split


def prose_to_lines(stories: DataFrame, cast: DataFrame | list[tuple[str, str]], mode: str = "generic", include_narration: bool = True, lexicon: dict | None = None) -> DataFrame:
    """(story_id, line_no, id, character, type, emotions, text, candidates) of (story_id, text)."""
    lines = split.split_lines(stories)
    told = speaker_blocks.detect_speakers(emotions.tag_emotions(lines, lexicon), cast, mode)
    return scripts.spoken(scripts.with_ids(told), include_narration).select("story_id", "line_no", "id", "character", "type", "emotions", "text", "candidates")


def analyze_script(lines: DataFrame, characters: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """Usage, totals and unsupported names of (story_id, line_no, line); characters: (character), tags: (emotion)."""
    parsed = scripts.parse_script(lines)
    used, felt = scripts.character_usage(parsed), scripts.emotion_usage(parsed)
    return {"characters": used, "emotions": felt, "totals": scripts.line_totals(lines), "unsupported_characters": scripts.unsupported(used, characters, "character"), "unsupported_emotions": scripts.unsupported(felt, tags, "emotion")}


def script_to_sequence(lines: DataFrame, voices: DataFrame) -> DataFrame:
    """Speech and pause entries of (story_id, line_no, line), with their starts."""
    parsed = scripts.parse_strict(lines).withColumn("text", F.col("speech"))
    return scripts.timeline(scripts.speech_sequence(scripts.with_voices(parsed, voices)))
