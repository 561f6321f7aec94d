"""Registered queries over the driver's tables, with DuckDB SQL for those that SQL can express.

The tables hold no speech, scripts or logs of their own, so each query first writes its rows into such a form, alike in
Spark and in SQL.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.data import load
from talespark.functions import text as T
from talespark.operators import catalog, chunking, emotions, logs, names, projects, scripts, speaker_blocks, speakers, split
from talespark.sources import readers, writers
from talespark.sources.shared import session_folder
from talespark.streaming import streams


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs, in Spark and as SQL ------------------------------------------------------------------------------------------

STORY_ID = "cast(conv_id AS string) || '-' || cast(turn AS string)"
PROSE = """'"' || text || '" ' || role || ' said. ' || text || ' he went on'"""


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story per message: the message as speech, an attribution, the message as narration, a tail without a final mark."""
    return _t(spark, sf_dir, "conversations").select(F.expr(STORY_ID).alias("story_id"), F.expr(PROSE).alias("text"))


PROSE_SQL = f"stories AS (SELECT {STORY_ID} AS story_id, {PROSE} AS text FROM conversations)"

LINE = """CASE turn % 5 WHEN 0 THEN '[' || role || '] (soft)(calm): ' || one WHEN 1 THEN role || ': *door* ' || one WHEN 2 THEN 'Bob said: ' || one WHEN 3 THEN '"' || one || '" Ann replied' ELSE '# ' || one END"""
#: All of a message's lines as one.
WHOLE = "replace(text, chr(10), ' ')"


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per conversation, a line per message with all its text, its form chosen by the turn."""
    rows = _t(spark, sf_dir, "conversations").selectExpr("conv_id AS story_id", "turn AS line_no", "turn", "role", f"{WHOLE} AS one")
    return rows.select("story_id", "line_no", F.expr(LINE).alias("line"))


SCRIPT_SQL = f"""script AS (SELECT story_id, line_no, {LINE} AS line FROM (SELECT conv_id AS story_id, turn AS line_no, turn, role, {WHOLE} AS one FROM conversations)),
clean AS (SELECT *, trim(line) AS l FROM script WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
formed AS (SELECT *, regexp_extract(l, '^\\[([^\\]]+)\\]\\s*(\\([^)]+\\))*\\s*:') AS head FROM clean),
parts AS (SELECT *, CASE
 WHEN head <> '' THEN struct_pack(c := trim(regexp_extract(l, '^\\[([^\\]]+)\\]', 1)), t := substr(l, length(head) + 1), e := regexp_extract_all(head, '\\(([^)]+)\\)', 1))
 WHEN contains(l, ':') AND NOT starts_with(l, '[') THEN struct_pack(c := trim(split_part(l, ':', 1)), t := substr(l, instr(l, ':') + 1), e := []::VARCHAR[])
 WHEN contains(lower(l), ' said') THEN NULL
 WHEN contains(l, '"') THEN struct_pack(c := CASE WHEN regexp_extract(regexp_replace(l, '"[^"]*"', '', 'g'), '\\b([A-Z][a-zA-Z]+)\\b', 1) = '' THEN 'Unknown' ELSE regexp_extract(regexp_replace(l, '"[^"]*"', '', 'g'), '\\b([A-Z][a-zA-Z]+)\\b', 1) END, t := regexp_extract(l, '"([^"]*)"', 1), e := []::VARCHAR[]) END AS p FROM formed),
parsed AS (SELECT story_id, line_no, p.c AS character, trim(regexp_replace(p.t, '\\*[^*]*\\*', '', 'g')) AS text, p.e AS emotions FROM parts WHERE p IS NOT NULL AND trim(regexp_replace(p.t, '\\*[^*]*\\*', '', 'g')) <> '')"""

WORD = "[\\p{L}\\p{N}_]"
LINES_SQL = rf"""{PROSE_SQL},
physical AS (SELECT story_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT story_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS ls FROM stories)),
marked AS (SELECT *, lag(line) OVER (PARTITION BY story_id ORDER BY pos) AS prev FROM physical),
grouped AS (SELECT story_id, pos, line, sum(CASE WHEN line = '' THEN 1 WHEN coalesce(prev, '') <> '' AND ((NOT regexp_matches(prev, '[.!?"”]$') AND regexp_matches(line, '^\p{{Ll}}')) OR NOT regexp_matches(line, '^\p{{L}}')) THEN 0 ELSE 1 END) OVER (PARTITION BY story_id ORDER BY pos) AS g FROM marked),
paras AS (SELECT story_id, g, trim(string_agg(line, ' ' ORDER BY pos)) AS para FROM grouped WHERE line <> '' GROUP BY story_id, g),
segs AS (SELECT story_id, g, para, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS seg FROM (SELECT *, string_split(trim(regexp_replace(translate(para, '“”‘’', '""' || repeat(chr(39), 2)), '\s+', ' ', 'g')), '"') AS ps FROM paras)),
sents AS (SELECT story_id, g, seg, para, CASE WHEN seg % 2 = 1 THEN 'dialogue' ELSE 'narration' END AS type, unnest(CASE WHEN seg % 2 = 1 THEN [trim(piece)] ELSE list_transform(regexp_extract_all(trim(piece), '([^.!?]*[.!?])', 1), lambda x: trim(x)) END) AS text, generate_subscripts(CASE WHEN seg % 2 = 1 THEN [trim(piece)] ELSE regexp_extract_all(trim(piece), '([^.!?]*[.!?])', 1) END, 1) AS k FROM segs),
numbered AS (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY g, seg, k) - 1 AS line_no, text, type, para AS raw FROM sents WHERE text <> ''),
lines AS (SELECT *, CASE WHEN type = 'dialogue' AND lead(type) OVER w = 'narration' AND (regexp_matches(lead(text) OVER w, '(?i)(^|[^\p{{L}}\p{{N}}_])({split.ATTRIBUTION_VERBS})($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(lead(text) OVER w, '(?i)(^|[^\p{{L}}\p{{N}}_])(he|she)\s+{WORD}')) THEN lead(text) OVER w END AS attribution FROM numbered WINDOW w AS (PARTITION BY story_id ORDER BY line_no))"""

#: Phrases that are written before a document's words, by its id, so that rules, cues and keywords have something to find.
PHRASES = ["", "she whispered", "he snarled", "a candle and wine", "you belong to me, under my control", "the storm was almost here", "not angry at all", "joyful and bold", "terrified and nervous", "is it late?", "please", "calm, steady and relaxed", "never sad"]
CUE = f"({' '.join(f'WHEN {k} THEN {chr(39)}{p}{chr(39)}' for k, p in enumerate(PHRASES))} END)".replace("(WHEN", f"(CASE doc_id % {len(PHRASES)} WHEN", 1)
CUE_TEXT = f"trim({CUE} || ' ' || text)"


def cue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.expr(CUE_TEXT).alias("text"))


CUE_SQL = f"cues AS (SELECT doc_id AS line_id, {CUE_TEXT} AS text FROM documents)"
#: As CUE_TEXT, but of letters and blanks alone, so that a cue is found whatever marks stand in or beside it.
LETTERS_TEXT = f"trim({CUE} || ' ' || regexp_replace(text, '[^a-zA-Z ]', ''{{}}))"


def two_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as it is (a cue may hold marks itself) and as letters and blanks."""
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.expr(CUE_TEXT).alias("text"), F.expr(LETTERS_TEXT.format("")).alias("plain"))


READINGS_SQL = f"""readings AS (SELECT doc_id AS line_id, {CUE_TEXT} AS text, {LETTERS_TEXT.format(", 'g'")} AS plain FROM documents)"""
#: What goes to lower(), which gives a dotted capital I as two code points in Spark.
TO_LOWER = "replace(text, 'İ', 'i' || chr(775))"

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DIAG' WHEN 'purchase' THEN 'UI' ELSE 'DEBUG' END"
LOG = f"'[' || {LEVEL} || '][app] Memory usage: ' || cast(cast(floor(value) AS bigint) AS varchar{{}}) || ' MB'"


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "ts", F.expr(LOG.format("(20)")).alias("line"))


LOG_SQL = "log AS (SELECT event_id, ts, " + LOG.format("") + " AS line FROM events)"
KEY = "'projects/' || cast(user_id AS varchar{}) || '/' || cast(event_id AS varchar{}) || CASE event_id % 3 WHEN 0 THEN '.gz' ELSE '.json' END"


def object_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.expr(KEY.format("(20)", "(20)")).alias("key"), F.col("ts").alias("last_modified"))


KEY_SQL = "files AS (SELECT user_id AS project, " + KEY.format("", "") + " AS key, ts AS last_modified FROM events)"



def cuts_sql(source: str, keys: str, limit: int) -> str:
    """Recursive tables of the pieces (keys, idx, piece) of ``source`` (keys, text): each step takes one off at the cursor."""
    least, each = int(limit * 0.6), ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""walk AS (SELECT {keys}, text, 0::BIGINT AS cursor_at, -1::BIGINT AS idx, NULL::VARCHAR AS piece FROM {source}
 UNION ALL SELECT {each}, c.text, CASE WHEN c.rest THEN length(c.text) + 1 WHEN c.taken = '' THEN c.cursor_at + {limit} ELSE c.cursor_at + c.step END, c.idx + 1, CASE WHEN c.rest THEN substr(c.text, c.cursor_at + 1) WHEN c.taken = '' THEN c.win ELSE c.taken END
 FROM (SELECT *, regexp_replace(substr(text, cursor_at + 1, step), '^\\s+|\\s+$', '', 'g') AS taken FROM (SELECT *, CASE WHEN dot >= {least} THEN dot + 1 ELSE {limit} END AS step FROM (SELECT *, length(text) - cursor_at <= {limit} AS rest, substr(text, cursor_at + 1, {limit}) AS win, CASE WHEN contains(substr(text, cursor_at + 1, {limit}), '.') THEN {limit} - strpos(reverse(substr(text, cursor_at + 1, {limit})), '.') ELSE -1 END AS dot FROM walk WHERE idx = -1 OR cursor_at < length(text)))) c),
pieces AS (SELECT {keys}, idx, piece FROM walk WHERE idx >= 0)"""


VOICES = [("user", "v1"), ("Ann", "v2"), ("Bob", "v3")]
VOICES_SQL = f"voices(character, voice_id) AS (VALUES {', '.join(map(str, VOICES))})"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Prose ----------------------------------------------------------------------------------------------------------------


@query("split_lines", f"WITH {LINES_SQL} SELECT story_id, line_no, text, type, raw, attribution FROM lines")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_lines(prose(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


@query("line_type_counts", f"WITH {LINES_SQL} SELECT story_id, count(*) FILTER (type = 'dialogue') AS dialogue, count(*) FILTER (type = 'narration') AS narration, count(*) AS total FROM lines GROUP BY story_id")
def line_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.line_type_counts(split.split_lines(prose(spark, sf_dir)))


@query("paragraph_merge", f"WITH {LINES_SQL.replace(PROSE_SQL, 'stories AS (SELECT doc_id AS story_id, text FROM documents)')} SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY g) - 1 AS para_no, para FROM paras WHERE para <> ''")
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.paragraphs(_t(spark, sf_dir, "documents"), "doc_id")
    return T.rows_of(found, F.col("paras"), "para_no", "story_id").select("story_id", F.col("para_no").cast("long").alias("para_no"), F.col("x").alias("para"))


@query("prev_next_context", f"WITH {LINES_SQL} SELECT story_id, line_no, lag(text) OVER w AS before, lead(text) OVER w AS after FROM lines WINDOW w AS (PARTITION BY story_id ORDER BY line_no)")
def prev_next_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotions.with_context(split.split_lines(prose(spark, sf_dir))).select("story_id", F.col("line_no").cast("long").alias("line_no"), "before", "after")


@query("candidate_phrases", r"""WITH found AS (SELECT doc_id AS story_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})\b', 1)) AS phrase FROM documents),
counts AS (SELECT story_id, min(phrase) AS phrase, count(*) AS uses FROM found GROUP BY story_id, trim(regexp_replace(lower(phrase), '[^a-z]+', ' ', 'g')) HAVING count(*) >= 2)
SELECT story_id, phrase, uses, place FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY uses DESC, phrase) AS place FROM counts) WHERE place <= 12""")
def candidate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.candidate_phrases(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), "text")).withColumn("place", F.col("place").cast("long"))


CAST = [("Ann", "F"), ("Bob", "M"), ("user", "M"), ("assistant", "F")]


@query("detect_speakers")
def detect_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = prose(spark, sf_dir)
    return speaker_blocks.detect_speakers(split.split_lines(stories), CAST).select("story_id", "line_no", "type", "character", "text")


def _rule_case() -> str:
    cases = [f"WHEN regexp_matches(lower(text), '{p}') THEN '{a},{b}'" for p, a, b in load("emotion_rules")["rules"]]
    return f"CASE {' '.join(cases)} END"


def _cue_sum(signal: str) -> str:
    return " + ".join("CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END".format(c.replace("'", "''")) for c in load("emotion_rules")["cues"][signal])


def _keyword_sql(word: str) -> str:
    return f"len(list_filter(range(1, len(tokens) + 1), lambda i: regexp_matches(tokens[i], '(?i)^[^a-z]*{word}([^a-z]|$)') AND NOT list_has_any(list_transform(tokens[greatest(1, i - 3):i - 1], lambda t: trim(lower(t), '.,!?;:\"()[]{{}}')), ['not', 'never', 'no'])))"


def _keywords_sql() -> str:
    return ", ".join(f"CAST({'+'.join(_keyword_sql(w) for w in ws)} AS BIGINT) AS {label}" for label, ws in load("emotion_rules")["lexicon"].items())


def _ranked_sql() -> str:
    return "list_transform(list_sort([" + ", ".join(f"{{'less': -{label}, 'k': {k}, 'label': '{label}'}}" for k, label in enumerate(load("emotion_rules")["lexicon"])) + "]), lambda x: CASE WHEN x.less < 0 THEN x.label END)[1:2]"


_MATES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in load("emotion_rules")["companions"].items())


#: First sentences, given to texts by their numbers: most say nothing about who speaks.
OPENINGS = ["Ann looked up. ", '"Go," said Bob. ', '"I know." ', "Bob's coat was wet. ", "She nodded. ", '"Stay here." ', "", ""]


@query("speakers_strict")
def speakers_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = prose(spark, sf_dir)
    return speaker_blocks.detect_speakers(split.split_lines(stories), CAST, "strict", auto_assign=False).select("story_id", "line_no", "type", "character", "text")


@query("speakers_aggressive")
def speakers_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = prose(spark, sf_dir)
    return speaker_blocks.detect_speakers(split.split_lines(stories), CAST, "aggressive").select("story_id", "line_no", "type", "character", "text")


@query("speakers_long_stories")
def speakers_long_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a source, each after one of OPENINGS, as one story, line by line: as long as the source is."""
    opening = F.get(F.array(*map(F.lit, OPENINGS)), F.pmod("doc_id", F.lit(len(OPENINGS))).cast("int"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split(F.concat_ws("\n", opening, "text"), "\n")).alias("k", "text"))
    speech = F.when(F.col("text").startswith('"'), "dialogue").otherwise("narration")
    lines = docs.select(F.col("source").alias("story_id"), (F.col("doc_id") * 1_000_000 + F.col("k")).alias("line_no"), "text", speech.alias("type"), F.col("text").alias("raw"), F.lit(None).cast("string").alias("attribution"))
    return speaker_blocks.detect_speakers(lines, CAST, "strict").select("story_id", "line_no", "type", "character")


@query("tag_emotions", f"""WITH {LINES_SQL},
told AS (SELECT story_id, line_no, concat_ws(' ', nullif(text, ''), nullif(attribution, ''), nullif(lag(text) OVER w, ''), nullif(lead(text) OVER w, '')) AS text FROM lines WINDOW w AS (PARTITION BY story_id ORDER BY line_no)),
cued AS (SELECT *, {_rule_case()} AS rule, {', '.join(f'({_cue_sum(s)}) AS {s}' for s in load('emotion_rules')['cues'])}, regexp_split_to_array(text, '\\s+') AS tokens FROM told),
scored AS (SELECT *, {_keywords_sql()} FROM cued),
named AS (SELECT *, CASE WHEN rule IS NOT NULL THEN string_split(rule, ',') WHEN arousal >= 2 OR (arousal > 0 AND romance > 0) THEN ['aroused', 'breathless'] WHEN romance >= 2 THEN ['romantic', 'soft']
 WHEN dominance > 0 AND (arousal > 0 OR tension > 0) THEN ['dominant', 'commanding'] WHEN dominance >= 2 THEN ['dominant', 'aggressive'] WHEN tension >= 2 THEN ['intense', 'shaky'] ELSE list_filter({_ranked_sql()}, lambda x: x IS NOT NULL) END AS found FROM scored)
SELECT story_id, line_no, array_to_string(CASE len(found) WHEN 2 THEN found
 WHEN 1 THEN [found[1], CASE WHEN coalesce(CASE lower(found[1]) {_MATES} END, 'soft') <> lower(found[1]) THEN coalesce(CASE lower(found[1]) {_MATES} END, 'soft') WHEN lower(found[1]) <> 'calm' THEN 'calm' ELSE 'soft' END]
 ELSE CASE WHEN arousal > 0 THEN ['aroused', 'breathless'] WHEN romance > 0 THEN ['romantic', 'soft'] WHEN dominance > 0 THEN ['dominant', 'commanding'] WHEN tension > 0 THEN ['intense', 'soft'] ELSE ['soft', 'calm'] END END, ',') AS emotions FROM named""")
def tag_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotions.tag_emotions(split.split_lines(prose(spark, sf_dir))).select("story_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("emotions", ",").alias("emotions"))


@query("subject_carry", "SELECT conv_id AS story_id, turn AS line_no, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations")
def subject_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("line_no"), F.expr("CASE WHEN turn % 3 = 0 THEN role END").alias("evidence"))
    return speakers.carry_subject(rows, "evidence").select("story_id", "line_no", "carried")


@query("recent_speakers", """WITH r AS (SELECT conv_id AS story_id, turn AS line_no, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS c FROM conversations)
SELECT story_id, line_no, last_value(c IGNORE NULLS) OVER (PARTITION BY story_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_speaker, coalesce(string_agg(c, ',') OVER (PARTITION BY story_id ORDER BY line_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), '') AS recent FROM r""")
def recent_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("line_no"), F.expr("CASE WHEN turn % 3 = 2 THEN 'Ambiguous' ELSE role END").alias("character"))
    return speakers.recent_speakers(rows).select("story_id", "line_no", "last_speaker", F.array_join("recent", ",").alias("recent"))


# Scripts --------------------------------------------------------------------------------------------------------------


@query("script_parse", f"WITH {SCRIPT_SQL} SELECT story_id, line_no, character, text, array_to_string(emotions, ',') AS emotions FROM parsed")
def script_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.parse_script(script(spark, sf_dir)).select("story_id", "line_no", "character", "text", F.array_join("emotions", ",").alias("emotions"))


@query("script_strict", f"WITH {SCRIPT_SQL} SELECT story_id, line_no, character, emotions[1] AS first_emotion, '[soft][calm] ' || text AS speech FROM parsed WHERE len(emotions) > 0")
def script_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.parse_strict(script(spark, sf_dir)).select("story_id", "line_no", "character", F.col("emotions")[0].alias("first_emotion"), "speech")


@query("script_format", f"WITH {SCRIPT_SQL} SELECT story_id, line_no, rtrim('[' || character || '] ' || CASE WHEN len(emotions) = 0 THEN '(soft)(calm)' ELSE array_to_string(list_transform(emotions, lambda e: '(' || e || ')'), '') END || ': ' || text) AS line FROM parsed")
def script_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.parse_script(script(spark, sf_dir)).select("story_id", "line_no", T.format_line(F.col("character"), F.col("emotions"), F.col("text")).alias("line"))


@query("standard_format", f"WITH {SCRIPT_SQL}, s AS (SELECT story_id, line_no, rtrim('[' || character || '] ' || CASE WHEN len(emotions) = 0 THEN '(soft)(calm)' ELSE '(soft)(calm)' END || ': ' || text) AS standard FROM parsed) SELECT story_id, line_no, CASE WHEN trim(line) = '' OR starts_with(trim(line), '#') THEN line ELSE coalesce(standard, '# UNPARSED: ' || line) END AS standard FROM script LEFT JOIN s USING (story_id, line_no)")
def standard_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.standard_format(script(spark, sf_dir)).select("story_id", "line_no", "standard")


@query("formatted_script", f"WITH {SCRIPT_SQL} SELECT story_id, string_agg(rtrim('[' || character || '] (soft)(calm): ' || text), chr(10) ORDER BY line_no) AS script FROM parsed GROUP BY story_id")
def formatted_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.formatted_script(scripts.parse_script(script(spark, sf_dir)))


@query("character_usage", f"WITH {SCRIPT_SQL} SELECT story_id, character, count(*) AS uses FROM parsed GROUP BY ALL")
def character_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.character_usage(scripts.parse_script(script(spark, sf_dir)))


@query("emotion_usage", f"WITH {SCRIPT_SQL} SELECT story_id, emotion, count(*) AS uses FROM (SELECT story_id, unnest(emotions) AS emotion FROM parsed) GROUP BY ALL")
def emotion_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.emotion_usage(scripts.parse_script(script(spark, sf_dir)))


@query("line_totals", f"WITH {SCRIPT_SQL} SELECT s.story_id, count(*) AS total_lines, count(p.line_no) AS parsed_lines FROM script s LEFT JOIN parsed p USING (story_id, line_no) GROUP BY s.story_id")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.line_totals(script(spark, sf_dir))


@query("unsupported_characters", f"WITH {SCRIPT_SQL}, {VOICES_SQL} SELECT character, count(*) AS uses FROM parsed WHERE character NOT IN (SELECT character FROM voices) GROUP BY character")
def unsupported_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = scripts.character_usage(scripts.parse_script(script(spark, sf_dir)))
    return scripts.unsupported(used, spark.createDataFrame(VOICES, "character string, voice_id string"), "character")


@query("unsupported_emotions", f"WITH {SCRIPT_SQL} SELECT emotion, count(*) AS uses FROM (SELECT unnest(emotions) AS emotion FROM parsed) WHERE emotion <> 'calm' GROUP BY emotion")
def unsupported_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    felt = scripts.emotion_usage(scripts.parse_script(script(spark, sf_dir)))
    return scripts.unsupported(felt, spark.createDataFrame([("calm",)], "emotion string"), "emotion")


@query("analysis_merge", f"WITH {SCRIPT_SQL} SELECT character, count(*) AS uses FROM parsed GROUP BY character")
def analysis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = scripts.parse_script(script(spark, sf_dir))
    parts = [parsed.filter(F.col("line_no") % 3 == k).groupBy("character").agg(F.count("*").alias("uses")) for k in range(3)]
    return scripts.merge_usage(*parts)


@query("voice_sequence", f"""WITH RECURSIVE {SCRIPT_SQL}, {VOICES_SQL}, v AS (SELECT * FROM parsed JOIN voices USING (character)),
long AS (SELECT story_id, line_no, text FROM v WHERE length(text) > 800), {cuts_sql("long", "story_id, line_no", 800)},
said AS (SELECT story_id, line_no, 0 AS part, character, voice_id, text FROM v WHERE length(text) <= 800 UNION ALL SELECT story_id, line_no, idx, character, voice_id, piece FROM v JOIN pieces USING (story_id, line_no)),
seq AS (SELECT story_id, line_no, part, 'speech' AS type, character, voice_id, text, NULL::INT AS duration FROM said UNION ALL SELECT story_id, line_no, max(part) + 1, 'pause', NULL, NULL, NULL, 300 FROM said GROUP BY story_id, line_no),
gap AS (SELECT *, coalesce(duration, 0) + CASE WHEN lead(type) OVER w <> 'pause' THEN 250 ELSE 0 END AS span FROM seq WINDOW w AS (PARTITION BY story_id ORDER BY line_no, part))
SELECT story_id, line_no, CAST(part AS BIGINT) AS part, type, character, voice_id, text, CAST(duration AS BIGINT) AS duration, CAST(coalesce(sum(span) OVER (PARTITION BY story_id ORDER BY line_no, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM gap""")
def voice_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    voiced = scripts.with_voices(scripts.parse_script(script(spark, sf_dir)), spark.createDataFrame(VOICES, "character string, voice_id string"))
    return scripts.timeline(scripts.speech_sequence(voiced)).withColumns({c: F.col(c).cast("long") for c in ("part", "duration", "start_ms")})


@query("resolve_ambiguous", """SELECT conv_id AS story_id, 'line_' || (turn + 1) AS id, CASE WHEN turn % 2 = 1 THEN role WHEN turn % 4 = 0 THEN 'Ann' ELSE 'Custom' END AS character FROM conversations""")
def resolve_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("line_no"), F.expr("CASE WHEN turn % 2 = 1 THEN role ELSE 'Ambiguous' END").alias("character"))
    lines = scripts.with_ids(rows)
    choices = lines.filter("character = 'Ambiguous'").select("story_id", "id", F.expr("CASE WHEN line_no % 4 = 0 THEN 'Ann' ELSE '' END").alias("choice"), F.lit("Custom").alias("custom"))
    return scripts.resolve_ambiguous(lines, choices).select("story_id", "id", "character")


@query("story_summary", "SELECT conv_id AS story_id, count(*) AS raw_line_count, count(*) FILTER (role <> 'system') AS dialogue_count, bool_or(turn % 4 = 3) AS has_ambiguity, count(DISTINCT CASE WHEN turn % 4 = 3 THEN 'Ambiguous' ELSE role END) AS characters FROM conversations GROUP BY conv_id")
def story_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), F.expr("CASE WHEN role = 'system' THEN 'narration' ELSE 'dialogue' END").alias("type"), F.expr("CASE WHEN turn % 4 = 3 THEN 'Ambiguous' ELSE role END").alias("character"))
    return scripts.story_summary(rows)


# Emotions -------------------------------------------------------------------------------------------------------------


@query("emotion_rules", f"WITH {CUE_SQL} SELECT line_id, {_rule_case()} AS labels FROM cues")
def emotion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_text(spark, sf_dir).select("line_id", F.array_join(emotions.rule_labels(F.col("text")), ",").alias("labels"))


@query("emotion_context", f"WITH {READINGS_SQL}, cues AS (SELECT line_id, {TO_LOWER} || chr(10) || plain AS text FROM readings) SELECT line_id, {', '.join(f'CAST({_cue_sum(s)} AS BIGINT) AS {s}' for s in load('emotion_rules')['cues'])} FROM cues")
def emotion_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings are looked through as one text; no cue holds the line feed between them.

    The first is left out where it adds nothing: a cue of letters and blanks in it stands in the second too, unless one of
    the two signs above ASCII that are lowered to an ASCII letter made it.
    """
    marked = [c for cues in load("emotion_rules")["cues"].values() for c in cues if not c.replace(" ", "").isalpha()]
    adds = reduce(or_, [F.contains(F.lower("text"), F.lit(c)) for c in marked] + [F.contains(F.col("text"), F.lit(c)) for c in "\u212a\u0130"])
    rows = two_readings(spark, sf_dir).select("line_id", F.concat_ws("\n", F.when(adds, F.col("text")), "plain").alias("text"))
    return rows.select("line_id", *(c.cast("long").alias(k) for k, c in emotions.cue_counts(F.col("text")).items()))


_LEXICON = load("emotion_rules")["lexicon"]
#: Every place of a keyword, of one word each: tokens between white space, the words within them, and the three tokens before.
HITS_SQL = rf"""{CUE_SQL}, lexicon(label, keyword) AS (VALUES {', '.join(f"('{k}', '{w}')" for k, ws in _LEXICON.items() for w in ws)}),
t AS (SELECT line_id, regexp_split_to_array(text, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+') AS tokens FROM cues),
u AS (SELECT line_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM t),
n AS (SELECT *, trim(lower(token), '.,!?;:"()[]{{}}' || chr(39)) IN ({', '.join("'" + w.replace("'", "''") + "'" for w in load("emotion_rules")["negations"])}) AS no FROM u),
d AS (SELECT *, coalesce(lag(no, 1) OVER w, false) OR coalesce(lag(no, 2) OVER w, false) OR coalesce(lag(no, 3) OVER w, false) AS denied FROM n WINDOW w AS (PARTITION BY line_id ORDER BY i)),
words AS (SELECT line_id, denied, unnest(regexp_split_to_array(lower(token), '[^\p{{L}}\p{{N}}_]+')) AS word FROM d),
hits AS (SELECT line_id, label, keyword, denied FROM words JOIN lexicon ON word = keyword)"""


@query("emotion_match_counts", f"WITH {HITS_SQL} SELECT line_id, label, keyword, count(*) AS matches, count(*) FILTER (denied) AS negated FROM hits GROUP BY ALL")
def emotion_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each keyword stands in each text, and how often denied: the places that emotion_matches gives, counted."""
    found = emotions.explain_emotions(cue_text(spark, sf_dir)).select("line_id", F.explode("matches").alias("m"))
    return found.groupBy("line_id", "m.label", "m.keyword").agg(F.count("*").alias("matches"), F.count_if("m.negated").alias("negated"))


@query("emotion_keywords", f"""WITH {HITS_SQL}, s AS (SELECT line_id, {', '.join(f"count(*) FILTER (label = '{k}') AS {k}" for k in _LEXICON)} FROM hits WHERE NOT denied GROUP BY line_id)
SELECT line_id, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _LEXICON)} FROM cues LEFT JOIN s USING (line_id)""")
def emotion_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = cue_text(spark, sf_dir).withColumn("s", emotions.keyword_scores(F.col("text")))
    return scores.select("line_id", *((-F.col("s")[k]["less"]).cast("long").alias(label) for k, label in enumerate(load("emotion_rules")["lexicon"])))


# Names ----------------------------------------------------------------------------------------------------------------


@query("name_normalize", r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ', (' || c_mktsegment || '!)'), '[()\[\].,''"!?-]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM customer""")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", T.normalize_name(F.expr("c_name || ', (' || c_mktsegment || '!)'")).alias("norm"))


@query("text_normalize", "SELECT conv_id, turn, replace(text, '.', '...') || ' \"x'' - ' AS plain FROM conversations")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_punctuation(F.concat(F.replace("text", F.lit("."), F.lit("…")), F.lit(" “x’ – "))).alias("plain"))


@query("name_map", r"""WITH users AS (SELECT DISTINCT s_name AS name, trim(regexp_replace(lower(replace(s_name, '#', ' ')), '[()\[\].,''"!?-]+', ' ', 'g')) AS norm FROM supplier),
entries AS (SELECT DISTINCT trim(regexp_replace(lower(replace(c_name, '#', ' ')), '[()\[\].,''"!?-]+', ' ', 'g')) AS e FROM customer),
variants AS (SELECT name, 0 AS part, regexp_replace(norm, '\s+', ' ', 'g') AS v FROM users UNION SELECT name, 1, unnest(regexp_split_to_array(norm, '\s+')) FROM users),
scored AS (SELECT name, e, part * 10 + CASE WHEN e = v THEN 0 WHEN list_contains(string_split(e, ' '), v) THEN 1 WHEN len(list_filter(string_split(e, ' '), lambda t: starts_with(t, v))) > 0 THEN 2 ELSE 3 END AS score FROM variants JOIN (SELECT regexp_replace(e, '\s+', ' ', 'g') AS e FROM entries) ON contains(e, v))
SELECT name, arg_min(e, (score, -length(e), e)) AS canonical FROM scored GROUP BY name""")
def name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("raw"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("name"))
    known = _t(spark, sf_dir, "customer").select(T.normalize_name(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("name_norm"))
    return catalog.map_names(users, known).join(users, "name").select(F.col("raw").alias("name"), "canonical")


# Logs and projects ----------------------------------------------------------------------------------------------------


@query("log_summary", f"WITH {LOG_SQL} SELECT {', '.join(f'count(*) FILTER (contains(line, {chr(39)}[{v}]{chr(39)})) AS {v.lower()}' for v in logs.LEVELS)}, round(avg(CASE WHEN contains(line, '[DIAG]') THEN CAST(regexp_extract(line, 'Memory usage: ([0-9.]+)', 1) AS DOUBLE) END), 2) AS avg_memory FROM log")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_summary(log_rows(spark, sf_dir))


@query("error_lines", f"WITH {LOG_SQL} SELECT event_id, line FROM log WHERE contains(line, '[ERROR]')")
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.error_lines(log_rows(spark, sf_dir)).select("event_id", "line")


@query("log_retention", f"WITH {KEY_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last_modified DESC, key DESC) AS place FROM files) SELECT project, key, place, CASE WHEN place > 25 THEN 'delete' WHEN date_diff('day', CAST(last_modified AS DATE), DATE '2024-01-31') >= 3 AND NOT ends_with(key, '.gz') THEN 'compress' ELSE 'keep' END AS action FROM p")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.retention(object_rows(spark, sf_dir), now="2024-01-31").select("project", "key", F.col("place").cast("long").alias("place"), "action")


@query("page_newest", f"WITH {KEY_SQL} SELECT key, last_modified FROM files WHERE ends_with(key, '.json') ORDER BY last_modified DESC, key LIMIT 10 OFFSET 20")
def page_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page(object_rows(spark, sf_dir), 2).select("key", "last_modified")


STATE = "user_id AS project_id, event_id AS idx, CASE WHEN event_type = 'view' THEN 'DONE' ELSE 'PENDING' END AS status, (user_id * 37) % 5000 AS committed_index"


@query("resume_pending", f"SELECT project_id, idx FROM (SELECT {STATE} FROM events) WHERE status <> 'DONE' AND idx > committed_index")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.pending(_t(spark, sf_dir, "events").selectExpr(*STATE.split(", ", 2)[:2], *STATE.split(", ", 2)[2].split(", (")[:1], "(" + STATE.split(", (")[1])).select("project_id", "idx")


@query("mark_done", f"SELECT project_id, idx, CASE WHEN idx % 7 = 0 THEN 'DONE' ELSE status END AS status FROM (SELECT {STATE} FROM events)")
def mark_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _t(spark, sf_dir, "events").selectExpr("user_id AS project_id", "event_id AS idx", "CASE WHEN event_type = 'view' THEN 'DONE' ELSE 'PENDING' END AS status")
    return projects.mark_done(state, state.filter("idx % 7 = 0"))


@query("commit_points", "WITH e AS (SELECT user_id AS project_id, event_id AS idx FROM events), m AS (SELECT project_id, max(idx) AS top FROM e GROUP BY 1) SELECT project_id, idx FROM e JOIN m USING (project_id) WHERE (idx + 1) % 5 = 0 OR idx = top")
def commit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.commit_points(_t(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("idx")))


@query("voice_settings", """WITH s AS (SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, l_discount * 8)) AS a, least(1.0, greatest(0.0, l_tax * 20)) AS b, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, l_quantity / 40)) END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a <= 0.25 THEN 0.0 WHEN a <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS stability, b AS similarity_boost, CASE WHEN c <= 0.25 THEN 0.0 WHEN c <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS style FROM s""")
def voice_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 8 AS stability", "l_tax * 20 AS similarity_boost", "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity / 40 END AS style")
    return projects.voice_settings(rows)


# Chunks ---------------------------------------------------------------------------------------------------------------


@query("fixed_windows", "SELECT doc_id, i AS idx, substr(text, CAST(i * 200 + 1 AS BIGINT), 200) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents)")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"), 200)).alias("idx", "piece"))
    return rows.withColumn("idx", F.col("idx").cast("long"))


@query("chunk_pack")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_text(_t(spark, sf_dir, "documents"), "doc_id")


@query("cursor_cuts", f"""WITH RECURSIVE docs AS (SELECT doc_id AS project_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents), {cuts_sql("docs", "project_id", 200)} SELECT project_id, idx, piece AS text FROM pieces""")
def cursor_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cursor_cuts(_t(spark, sf_dir, "documents"), "doc_id").withColumn("idx", F.col("idx").cast("long"))


# Smaller operators ----------------------------------------------------------------------------------------------------


@query("session_resume", f"WITH {KEY_SQL}, top AS (SELECT * FROM files ORDER BY last_modified DESC, key DESC LIMIT 3) SELECT key FROM top WHERE last_modified >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14400 MINUTE AND NOT ends_with(key, '.gz') ORDER BY last_modified DESC, key DESC LIMIT 1")
def session_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.resumable_session(object_rows(spark, sf_dir), "2024-01-30 00:00:00", minutes=14400).select("key")


@query("log_parse", f"WITH {LOG_SQL} SELECT event_id, regexp_extract(line, '^\\[([A-Z]+)\\]', 1) AS level, 'app' AS source, regexp_extract(line, '\\] (.*)$', 1) AS message FROM log")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_rows(spark, sf_dir).withColumn("value", F.concat(F.lit("[2024-01-01 00:00:00 UTC] "), F.col("line")))
    return logs.parse_log(rows).select("event_id", "level", "source", "message")


@query("committed_index", "WITH s AS (SELECT user_id AS project_id, event_id % 100 AS committed_index FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, NULL FROM events UNION ALL SELECT user_id, event_id % 90 FROM events WHERE event_type = 'click') SELECT project_id, coalesce(max(committed_index), -1) AS committed_index FROM s GROUP BY project_id")
def committed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events")
    state = rows.selectExpr("user_id AS project_id", "CASE WHEN event_type = 'view' THEN event_id % 100 END AS committed_index")
    return projects.committed_index(state, rows.filter("event_type = 'click'").selectExpr("user_id AS project_id", "event_id % 90 AS committed_index"))


@query("upsert_state", "SELECT event_id AS idx, user_id AS project_id, CASE WHEN event_id % 4 = 0 THEN 'DONE' ELSE event_type END AS status FROM events")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _t(spark, sf_dir, "events").selectExpr("user_id AS project_id", "event_id AS idx", "event_type AS status")
    return projects.upsert_state(state, state.filter("idx % 4 = 0").withColumn("status", F.lit("DONE"))).select("idx", "project_id", "status")


@query("overlay_voices", f"WITH {VOICES_SQL} SELECT conv_id, turn, coalesce(v.voice_id, l.voice_id, 'own') AS voice_id FROM (SELECT *, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'BOB' ELSE 'Zoe' END AS character FROM conversations) c LEFT JOIN voices v ON v.character = c.character LEFT JOIN voices l ON lower(l.character) = lower(c.character)")
def overlay_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'BOB' ELSE 'Zoe' END").alias("character"), F.lit("own").alias("voice_id"))
    return projects.overlay_voices(rows, spark.createDataFrame(VOICES, "character string, voice_id string")).select("conv_id", "turn", "voice_id")


@query("missing_voices", f"WITH {SCRIPT_SQL}, {VOICES_SQL} SELECT story_id, line_no, character FROM parsed WHERE character NOT IN (SELECT character FROM voices)")
def missing_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.without_voices(scripts.parse_script(script(spark, sf_dir)), spark.createDataFrame(VOICES, "character string, voice_id string")).select("story_id", "line_no", "character")


@query("spoken_lines", f"WITH {LINES_SQL} SELECT story_id, 'line_' || (line_no + 1) AS id, text FROM lines WHERE type <> 'narration'")
def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.spoken(scripts.with_ids(split.split_lines(prose(spark, sf_dir))), False).select("story_id", "id", "text")


GROUPS = "map('leads', map('Mara Lind', named_struct('voice_id', cast(null AS string), 'gender', 'F'), 'customer', named_struct('voice_id', 'v7', 'gender', 'M')), 'rest', map('mara  lind', named_struct('voice_id', 'v8', 'gender', 'F')))"


@query("catalog_flatten", """WITH e AS (SELECT conv_id, role || ' ' || turn % 2 AS name_norm, turn, role || ' ' || turn % 2 || repeat('!', turn) AS display, CASE WHEN turn >= 2 THEN 'v' || turn END AS voice_id, CASE turn % 3 WHEN 1 THEN 'F' WHEN 2 THEN 'M' END AS gender FROM conversations)
SELECT conv_id, name_norm, arg_min(display, turn) AS display, arg_min(voice_id, turn) FILTER (voice_id IS NOT NULL) AS voice_id, arg_min(gender, turn) FILTER (gender IS NOT NULL) AS gender FROM e GROUP BY conv_id, name_norm""")
def catalog_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON catalog for each conversation: group is the role, names are spelled in as many ways as there are turns."""
    entry = F.expr("struct(turn, '\"' || role || ' ' || turn % 2 || repeat('!', cast(turn AS int)) || '\":' || to_json(struct(CASE WHEN turn >= 2 THEN 'v' || turn END AS voice_id, CASE turn % 3 WHEN 1 THEN 'F' WHEN 2 THEN 'M' END AS gender)) AS json)")
    joined = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["json"]), ","), F.lit("}"))
    groups = _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(joined(entry).alias("names"))
    catalogs = groups.groupBy("conv_id").agg(joined(F.struct("role", F.concat(F.lit('"'), "role", F.lit('":'), "names").alias("json"))).alias("json"))
    return catalog.flatten_catalog(catalogs.select("conv_id", F.from_json("json", readers.CATALOG_SCHEMA).alias("groups")), by=("conv_id",)).drop("ord")


@query("display_names", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Mara Lind' ELSE upper(role[1]) || role[2:] END AS display FROM conversations")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CASE WHEN turn % 2 = 0 THEN 'MARA, Lind!' ELSE role END").alias("character"))
    return catalog.display_names(rows, catalog.flatten_catalog(spark.sql(f"SELECT {GROUPS} AS groups"))).select("conv_id", "turn", "display")


@query("cast_genders", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' END AS catalog_gender FROM customer")
def cast_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN '(Mara) LIND' ELSE c_name END").alias("name"))
    return catalog.genders(rows, catalog.flatten_catalog(spark.sql(f"SELECT {GROUPS} AS groups"))).select("c_custkey", "catalog_gender")


@query("cast_names", "SELECT c_custkey, 'Customer ' || c_custkey AS name FROM customer")
def cast_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", T.cast_name(F.expr("'  Customer   ' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN ' - Female ' WHEN 1 THEN ', man' ELSE '' END")).alias("name"))


@query("name_variants", r"SELECT DISTINCT r_name, r_name || ' Q. Vale,' || lower(r_name) || ' q vale,' || lower(regexp_extract(r_name, '^\S+')) || ',vale,' || array_to_string(list_transform(string_split(lower(r_name) || ' q vale', ' '), lambda t: t[1]), '') || ',' || array_to_string(list_transform(string_split(lower(r_name) || ' q vale', ' '), lambda t: t[1]), '.') || '.' AS variants FROM region")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "region").select("r_name", F.array_join(catalog.name_variants(F.concat("r_name", F.lit(" Q. Vale"))), ",").alias("variants"))


@query("direct_names", r"SELECT doc_id, CASE WHEN contains(n, ' the ') THEN 'The' WHEN contains(n, ' und ') THEN 'und' END AS name FROM (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[()\[\].,''\"!?-]+', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS n FROM documents)".replace('\\"', '"'))
def direct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", catalog.first_name_in(F.col("text"), ["The", "und"]).alias("name"))


@query("chunk_tasks", f"""WITH {VOICES_SQL}, l AS (SELECT {STORY_ID} AS project_id, generate_subscripts(ls, 1) - 1 AS line_no, trim(unnest(ls)) AS line, role FROM (SELECT conv_id, turn, role, string_split('[' || role || '] ' || text, chr(10)) AS ls FROM conversations)),
k AS (SELECT *, CASE WHEN line_no = 0 THEN role ELSE NULL END AS who FROM l WHERE line <> ''),
w AS (SELECT project_id, line_no, line, who, unnest(range(0, CAST(ceil(length(line) / 200.0) AS BIGINT))) AS part FROM k)
SELECT project_id, CAST(line_no AS BIGINT) AS line_no, part, substr(line, CAST(part * 200 + 1 AS BIGINT), 200) AS text, coalesce(voice_id, 'none') AS voice_id FROM w LEFT JOIN voices ON character = who""")
def chunk_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.expr(STORY_ID).alias("project_id"), F.expr("'[' || role || '] ' || text").alias("text"))
    out = chunking.chunk_tasks(rows, spark.createDataFrame(VOICES, "character string, voice_id string"), default_voice="none")
    return out.withColumns({c: F.col(c).cast("long") for c in ("line_no", "part")})


LEXICON_ROWS = "SELECT p_brand AS label, unnest(string_split(p_name, ' ')) AS keyword FROM part"


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of the parts: brands with the words of their names, every other part's in capitals."""
    name = F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END")
    return _t(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.posexplode(F.split(name, " ")).alias("idx", "keyword"))


@query("lexicon_shared", f"SELECT lower(keyword) AS keyword, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM ({LEXICON_ROWS}) GROUP BY 1 HAVING count(DISTINCT label) > 1")
def lexicon_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotions.lexicon_metadata(lexicon_rows(spark, sf_dir))[1].withColumn("labels", F.array_join("labels", ","))


@query("lexicon_counts", f"SELECT label, count(*) AS keywords FROM ({LEXICON_ROWS}) GROUP BY label")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotions.lexicon_metadata(lexicon_rows(spark, sf_dir))[0]


@query("story_log", f"WITH {LINES_SQL} SELECT story_id, line_no, text, type, attribution, 'run' AS run_id FROM lines")
def story_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as a JSON log of a run, and read back."""
    lines, folder = split.split_lines(prose(spark, sf_dir)).drop("raw"), session_folder(spark, "story-log")
    writers.write_lines_json(lines, folder, "run")
    return spark.read.schema("story_id string, line_no long, text string, type string, attribution string, run_id string").json(folder)


@query("voice_mappings", "SELECT 'p' || s_nationkey AS project, s_name AS character, 'v' || (s_suppkey % 9) AS voice_id FROM supplier")
def voice_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices of each project's characters written as JSON, and read back."""
    rows = _t(spark, sf_dir, "supplier").select(F.expr("'p' || s_nationkey").alias("project"), F.col("s_name").alias("character"), F.expr("'v' || (s_suppkey % 9)").alias("voice_id"))
    writers.write_voice_mappings(rows, folder := session_folder(spark, "voices"))
    return readers.read_voice_mappings(spark, folder)


@query("file_names", "SELECT p_partkey, replace(p_brand, '#', '') || '_' || replace(p_type, ' ', '_') AS file FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", T.file_name(F.expr("'?' || p_brand || ' -  ' || p_type || ':'")).alias("file"))


@query("emotion_matches")
def emotion_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = emotions.explain_emotions(cue_text(spark, sf_dir)).select("line_id", F.explode("matches").alias("m"))
    return found.select("line_id", "m.*")


@query("word_counts", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, substr(text, 1, 80) AS preview FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), T.preview(F.col("text"), 80).alias("preview"))


# Names in prose -------------------------------------------------------------------------------------------------------

#: A catalog for the texts, in its order.
FIRST_WORDS = [("Bela Und", "M", 0), ("the", "f", 1), ("Und", "M", 2), ("de la", "x", 3)]
FIRST_SQL = f"catalog(display, gender, ord) AS (VALUES {', '.join(map(str, FIRST_WORDS))})"
_PLAIN = r"""' ' || trim(regexp_replace(regexp_replace(lower({}), '[()\[\].,''"!?-]+', ' ', 'g'), '\s+', ' ', 'g')) || ' '"""


def first_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIRST_WORDS, "display string, gender string, ord int")


@query("first_names", f"WITH {FIRST_SQL} SELECT doc_id AS story_id, (SELECT arg_min(display, ord) FROM catalog WHERE contains({_PLAIN.format('text')}, ' ' || lower(display) || ' ')) AS name FROM documents")
def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.first_names(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), "text"), first_words(spark)).select("story_id", "name")


@query("catalog_hits", rf"WITH {FIRST_SQL}, t AS (SELECT doc_id AS story_id, regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g') AS low FROM documents), h AS (SELECT story_id, display, len(regexp_extract_all(low, '\b' || lower(display) || '\b')) AS uses FROM t, catalog) SELECT story_id, display, uses FROM h WHERE uses > 0")
def catalog_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), "text")
    return names.catalog_hits(docs, first_words(spark)).filter("uses > 0").select("story_id", "display", F.col("uses").cast("long").alias("uses"))


@query("name_candidates")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_candidates(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), "text"), first_words(spark))


ODD_NAME = "CASE conv_id % 5 WHEN 0 THEN 'Ann van Lee' WHEN 1 THEN 'mother ' || role WHEN 2 THEN 'Bo' || role WHEN 3 THEN role WHEN 4 THEN 'A B C D E' END"


@query("name_looks", f"SELECT conv_id, turn, conv_id % 5 IN (0, 2) AS looks FROM (SELECT *, {ODD_NAME} AS name FROM conversations)")
def name_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", names.looks_like_name(F.expr(ODD_NAME)).alias("looks"))


@query("model_names", "SELECT user_id AS story_id, min(event_id) AS ord, 'Name' || chr(CAST(65 + event_id % 15 AS INT)) AS name FROM events GROUP BY user_id, event_id % 15 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) <= 12")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("story_id"), F.col("event_id").alias("ord"), F.expr("'Name' || chr(65 + event_id % 15)").alias("name"))
    return names.model_names(rows)


@query("cast_enabled", "SELECT c_custkey, 'Customer ' || c_custkey AS name, c_custkey % 4 = 0 AS exists_in_config FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0")
def cast_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE ' Customer ' || c_custkey || ' ' END").alias("name"), F.expr("CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END").alias("enabled"))
    known = _t(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.expr("'CUSTOMER ' || c_custkey").alias("name"))
    return catalog.enabled_cast(rows, known).select("c_custkey", "name", "exists_in_config")


@query("guess_genders", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'U' END AS guessed FROM customer")
def guess_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Ada' WHEN 1 THEN 'ADA' ELSE 'Odd' END").alias("name"))
    known = spark.createDataFrame([("ada", "u", 0), ("Ada", " f", 1), ("Odd", "none", 2)], "display string, gender string, ord int")
    return catalog.guess_genders(rows, known).select("c_custkey", "guessed")


@query("known_names", f"WITH {FIRST_SQL} SELECT display AS name FROM catalog UNION SELECT role FROM conversations")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.known_names(first_words(spark), _t(spark, sf_dir, "conversations").select(F.col("role").alias("character")))


@query("preferred_names", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN turn % 2 = 0 THEN 'BOB' END AS chosen FROM conversations")
def preferred_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = F.expr("CASE WHEN turn % 2 = 0 THEN array(role, 'BOB', 'Ann') ELSE array('Zoe', role) END")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", speakers.preferred(offered, ["bob!", "User", ""]).alias("chosen"))


@query("gender_words", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'nonbinary' WHEN 2 THEN 'male' ELSE 'unknown' END AS label, CASE turn % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'U' WHEN 2 THEN 'M' ELSE 'F' END AS letter, CASE turn % 4 WHEN 0 THEN 'Woman' WHEN 1 THEN 'Nb' WHEN 2 THEN 'M' ELSE 'Frau' END AS shown FROM conversations")
def gender_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.expr("CASE turn % 4 WHEN 0 THEN 'wOMAN' WHEN 1 THEN 'NB' WHEN 2 THEN 'm' ELSE 'fRAU' END")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.gender_label(hint).alias("label"), T.gender_letter(hint).alias("letter"), T.canonical(hint).alias("shown"))


#: Characters of words and white space, as Spark's patterns have them under (?U).
WORD_SIGNS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
SPACES = r"[\x{09}-\x{0D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _feminine_sql(text: str) -> str:
    return f"regexp_matches(' ' || lower({text}) || ' ', ' ({'|'.join(speakers.FEMALE_WORDS)}) ') OR regexp_matches(lower({text}), '{'|'.join(speakers.FEMALE_NOUNS)}')"


def _attributive_sql(text: str, low: str) -> str:
    """An opening or 's voice in any case (Spark takes all four i for one), or a verb in the lowered text."""
    end, folded = f"($|[^{WORD_SIGNS}])", f"translate({text}, 'İı', 'ii')"
    return f"regexp_matches({folded}, '(?i)^{SPACES}*([{WORD_SIGNS}]+[, ]+)?({speakers.OPENERS}){end}') OR regexp_matches({folded}, '(?i)[{WORD_SIGNS}]''s (voice|whisper){end}') OR regexp_matches(lower({low}), '{speakers.VERBS}')"


@query("feminine_cues", f"WITH {READINGS_SQL} SELECT line_id, {_feminine_sql(TO_LOWER)} OR {_feminine_sql('plain')} AS feminine, {_attributive_sql('text', TO_LOWER)} OR {_attributive_sql('plain', 'plain')} AS attributive FROM readings")
def feminine_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue counts in either reading."""
    either = lambda cue: cue(F.col("text")) | cue(F.col("plain"))
    return two_readings(spark, sf_dir).select("line_id", either(speakers.has_feminine_cue).alias("feminine"), either(speakers.looks_like_attribution_text).alias("attributive"))


# Sources, sinks and views ---------------------------------------------------------------------------------------------


@query("teaser_stats", "SELECT doc_id AS story_id, n AS lines, n <= 5 AS fits, n * 3 AS seconds FROM (SELECT doc_id, len(list_filter(string_split(CASE WHEN doc_id % 5 = 0 THEN '#' || text ELSE text END, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))) AS n FROM documents)")
def teaser_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), F.expr("CASE WHEN doc_id % 5 = 0 THEN '#' || text ELSE text END").alias("text"))
    return scripts.teaser_stats(rows).withColumns({c: F.col(c).cast("long") for c in ("lines", "seconds")})


@query("piece_metrics", "SELECT doc_id AS project_id, CAST(ceil(length(text) / 200.0) AS BIGINT) AS pieces, length(text) / ceil(length(text) / 200.0) AS avg_chars FROM documents WHERE length(text) > 0")
def piece_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.piece_metrics(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), F.explode(chunking.fixed_windows(F.col("text"), 200)).alias("text")))


@query("text_digests", r"SELECT doc_id, sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.text_digest(F.concat(F.lit(" \n"), "text")).alias("digest"))


@query("response_texts", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS answer FROM conversations WHERE text <> '' GROUP BY conv_id")
def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = F.struct(F.struct(F.col("text").alias("value")).alias("text"))
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.array(piece).alias("content")))).alias("turns"))
    return turns.select("conv_id", T.response_text(F.transform("turns", lambda t: F.struct(t["content"].alias("content")))).alias("answer"))


@query("object_get", "SELECT p.c_custkey, e.event_id FROM customer p LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) e ON e.user_id = p.c_custkey AND e.user_id % 3 <> 0")
def object_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id")).filter("user_id % 3 <> 0")
    objects = stored.select(F.expr("'projects/' || user_id || '.json'").alias("key"), F.to_json(F.struct("event_id")).alias("body"))
    asked = _t(spark, sf_dir, "customer").select("c_custkey", F.expr("'projects/' || c_custkey || '.json'").alias("key"))
    return readers.get_objects(asked, objects, "event_id long").select("c_custkey", F.col("data.event_id").alias("event_id"))


@query("object_exists", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def object_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "customer").select("c_custkey", F.expr("'projects/' || c_custkey").alias("key"))
    return readers.existing(asked, _t(spark, sf_dir, "events").select(F.expr("'projects/' || user_id").alias("key"))).select("c_custkey")


@query("object_put", f"WITH {KEY_SQL} SELECT key, CASE WHEN ends_with(key, '.gz') THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_modified END AS last_modified FROM files WHERE NOT contains(key, '/7')")
def object_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = object_rows(spark, sf_dir).select("key", "last_modified")
    fresh = files.filter(F.col("key").endswith(".gz")).withColumn("last_modified", F.lit("2024-02-01 00:00:00").cast("timestamp").cast(files.schema["last_modified"].dataType))
    return writers.remove_objects(writers.put_objects(files, fresh), files.filter(F.contains("key", F.lit("/7"))))


@query("log_names", f"WITH {KEY_SQL} SELECT key FROM files WHERE contains(key, '/12') AND contains(lower(key), '.json') ORDER BY key DESC LIMIT 10 OFFSET 10")
def log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_page(logs.named_like(object_rows(spark, sf_dir), "/12", ".JSON"), 1).select("key")


@query("recent_keys", f"WITH {KEY_SQL} SELECT key FROM files WHERE ends_with(key, '.json') ORDER BY last_modified DESC, key LIMIT 20")
def recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.recent(object_rows(spark, sf_dir)).select("key")


@query("history_view", "SELECT event_id AS project_id, CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) END AS updated FROM events")
def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("project_id"), F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon")).alias("last_updated"))
    return logs.history(rows).select("project_id", "updated")


@query("log_lines", "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC] [' || upper(event_type) || ']' || CASE WHEN event_id % 2 = 0 THEN '[ui]' ELSE '' END || ' event ' || event_id AS line, strftime(ts, '%b %d, %Y, %I:%M %p') AS shown FROM events")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_id") % 2 == 0, F.lit("ui"))
    return _t(spark, sf_dir, "events").select("event_id", logs.log_line(F.col("ts"), F.col("event_type"), F.expr("'event ' || event_id"), source).alias("line"), T.show_time(F.col("ts")).alias("shown"))


@query("error_rows", "SELECT event_id, 0 AS place, 'ERROR' AS level, event_type || ': ' || props AS message FROM events UNION ALL SELECT event_id, 1, NULL, 'at ' || user_id FROM events UNION ALL SELECT event_id, 2, NULL, 'in job' FROM events")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = logs.error_rows(F.col("event_type"), F.col("props"), F.expr("'at ' || user_id || chr(10) || chr(10) || 'in job' || chr(10)"))
    return _t(spark, sf_dir, "events").select("event_id", F.posexplode(made).alias("place", "r")).select("event_id", F.col("place").cast("long").alias("place"), "r.*")


@query("structured_log", """SELECT event_id, '[JSON] {"level":"' || event_type || '","event":' || event_id || ',"user":' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'null' END || '}' AS line FROM events""")
def structured_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"level": F.col("event_type"), "event": F.col("event_id"), "user": F.when(F.col("event_id") % 2 == 0, F.col("user_id"))}
    return _t(spark, sf_dir, "events").select("event_id", logs.structured_line(fields).alias("line"))


@query("parsed_times", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN '0001-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda f: F.date_format("ts", f)
    text = F.when(F.col("event_id") % 4 == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, form("yyyy-MM-dd'T'HH-mm-ss'Z'")).when(F.col("event_id") % 4 == 2, form("yyyy-MM-dd_HH-mm-ss")).otherwise("later")
    return _t(spark, sf_dir, "events").select("event_id", F.date_format(T.parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("voice_assignments", "SELECT DISTINCT role AS character, 'v-' || role AS voice_id FROM conversations")
def voice_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = _t(spark, sf_dir, "conversations").select(F.col("role").alias("character"), F.concat(F.lit("v-"), "role").alias("voice_id")).distinct()
    return projects.voice_assignments([saved.limit(0), saved, spark.createDataFrame(VOICES, "character string, voice_id string")], spark.createDataFrame([("Mara", "v9")], "display string, voice_id string"))


@query("default_voices", "SELECT 'v1' AS voice_id")
def default_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "NARRATOR").otherwise(F.col("role")).alias("character"), F.when(F.col("role") == "user", "v1").otherwise("v2").alias("voice_id"))
    return projects.default_voice(rows)


@query("voice_descriptions", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'warm' ELSE 'Custom voice assignment' END AS description FROM conversations")
def voice_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("voice_id"))
    return projects.voice_descriptions(rows, spark.createDataFrame([("user", "warm"), ("user", "wide")], "voice_id string, description string")).select("conv_id", "turn", "description")


@query("project_names", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN 'upload' ELSE 'global' END AS project FROM conversations")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS pasted", "CASE WHEN turn % 3 < 2 THEN 'upload' END AS uploaded")
    return projects.project_names(rows, ["pasted", "uploaded"]).select("conv_id", "turn", "project")


@query("project_settings", "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS stability, CASE WHEN c_custkey % 2 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS similarity_boost, 0.0::DOUBLE AS style FROM customer")
def project_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    saved = rows.filter("project_id % 2 = 0").selectExpr("project_id", "7.0D AS stability", "0.25D AS similarity_boost", "cast(null AS double) AS style")
    return projects.project_settings(rows, saved)


@query("effect_usage", "SELECT conv_id AS story_id, NULL::VARCHAR AS effect, 0::BIGINT AS uses FROM conversations WHERE false")
def effect_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.effect_usage(scripts.parse_script(script(spark, sf_dir)))


@query("readable_log", f"WITH {LINES_SQL}, n AS (SELECT story_id, upper(type) || ': ' || count(*) AS one, count(*) AS n FROM lines GROUP BY story_id, type) SELECT story_id, line_no, printf('%02d', line_no + 1) || '. [' || upper(type) || '] ' || text AS value FROM lines UNION ALL SELECT story_id, NULL, sum(n)::BIGINT || ' lines. ' || string_agg(one, ', ' ORDER BY one) FROM n GROUP BY story_id")
def readable_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.readable_log(split_lines(spark, sf_dir))


@query("log_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS lines FROM events GROUP BY 1, 2")
def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's aggregation over a bounded input, where no line is late."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    rows = _t(spark, sf_dir, "events").select(logs.log_line(F.col("ts"), level, F.col("props")).alias("value"))
    return streams.level_counts(rows).select("window.start", "level", "lines")


@query("user_sessions", "WITH e AS (SELECT user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 86400000000, true) AS fresh FROM events), s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS stop, count(*) AS events FROM s GROUP BY user_id, n")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(_t(spark, sf_dir, "events"), gap="1 day").select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "events")


@query("upload_limit", "SELECT doc_id, length(text) > 3000 AS cut, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || '# [text truncated]' ELSE text END AS text FROM documents")
def upload_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit at ingest, which is the feature; 3000 here, so that it is met."""
    return _t(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 3000).alias("cut"), readers.bounded(F.col("text"), 3000).alias("text"))
