"""Operators on small tables, and registered queries against their SQL."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from talespark import queries as core
from talespark.functions import text as T
from talespark.operators import catalog, chunking, emotions, logs, projects, scripts, speaker_blocks, speakers, split
from talespark.plans import stories as plans
from talespark.sources import readers, writers
from talespark.streaming import streams

DATA = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = core.QUERIES[name](spark, DATA)
    found = con.execute(core.SQL[name])
    columns = [c[0] for c in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    rounded = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted((rounded(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == sorted((rounded(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_split_lines(spark):
    text = 'Rain fell\nall night. “Come in,” Ilse said.\n\nHe waited. "Not now\n42 more came. lost tail'
    rows = split.split_lines(spark.createDataFrame([(1, text), (2, None), (3, "  \n ")], "story_id long, text string")).orderBy("line_no").collect()
    assert [(r.type, r.text, r.attribution) for r in rows] == [
        ("narration", "Rain fell all night.", None), ("dialogue", "Come in,", "Ilse said."), ("narration", "Ilse said.", None), ("narration", "He waited.", None), ("dialogue", "Not now 42 more came. lost tail", None),
    ]


def test_text_functions(spark):
    assert value(spark, T.normalize_name(F.lit(" O'Hara, (Jr.)  "))) == "o hara jr"
    assert value(spark, T.display_name(F.lit("anna-maria van McAll"))) == "Anna-Maria Van McAll"
    assert value(spark, T.cast_name(F.lit(" Ann  Lee - female "))) == "Ann Lee"
    assert value(spark, T.file_name(F.lit("a  b: c-d?"))) == "a_b_c_d"
    assert value(spark, T.nearest_level(F.lit(0.25))) == 0.0
    assert value(spark, T.gender_letter(F.lit("woman"))) == "U"
    assert value(spark, F.year(T.parse_time(F.lit("bad")))) == 1


def test_flexible_script_lines(spark):
    lines = ["[Ann] (sad)(low): Hi *door* there", "At 10:30 we left", 'Bob said hello', '"Go," Ann cried', "[broken: x", "# note", "", "plain"]
    rows = scripts.parse_script(spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)], "story_id int, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.character, r.text, r.emotions) for r in rows] == [("Ann", "Hi  there", ["sad", "low"]), ("At 10", "30 we left", []), ("Bob", "hello", []), ("Ann", "Go,", [])]


def test_emotions(spark):
    said = [("He whispered.", ["soft", "breathy"]), ("A kiss and wine.", ["romantic", "soft"]), ("joyful day", ["happy", "playful"]), ("not joyful", ["soft", "calm"]), ("a desperate plea", ["aroused", "breathless"])]
    for text, want in said:
        df = spark.createDataFrame([(1, 0, text, None)], "story_id int, line_no int, text string, attribution string")
        assert emotions.tag_emotions(df).first().emotions == want, text


def test_catalog(spark):
    groups = spark.sql("""select map('a', map('Ilse', named_struct('voice_id', cast(null as string), 'gender', 'F'), 'Tom B.', named_struct('voice_id','t','gender','M')), 'b', map('ilse', named_struct('voice_id','v','gender','F'))) groups""")
    flat = {r.name_norm: r for r in catalog.flatten_catalog(groups).collect()}
    assert flat["ilse"].voice_id == "v" and flat["ilse"].display == "Ilse" and set(flat) == {"ilse", "tom b"}
    found = catalog.map_names(spark.createDataFrame([("Tom",), ("ils",), ("omx",)], "name string"), catalog.flatten_catalog(groups))
    assert {r.name: r.canonical for r in found.collect()} == {"Tom": "tom b", "ils": "ilse"}
    assert value(spark, catalog.name_variants(F.lit("Anna Berg"))) == ["Anna Berg", "anna", "berg", "ab", "a.b."]
    assert value(spark, catalog.first_name_in(F.lit("Never. Eve came"), ["Adam", "Eve"])) == "Eve"


def plain_chunks(text, most):
    import re

    done, now = [], ""
    for p in [p.strip() for p in re.split(r"\n{2,}", text or "") if p.strip()]:
        if len(p) <= most and len(now) + len(p) + (2 if now else 0) <= most:
            now = f"{now}\n\n{p}" if now else p
            continue
        for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]:
            if len(s) > most:
                done += [now] * bool(now) + [s[k : k + most] for k in range(0, len(s), most)]
                now = ""
            elif now and len(now) + 1 + len(s) > most:
                done.append(now)
                now = s
            else:
                now = f"{now} {s}" if now else s
        if now and len(now) + 2 <= most:
            now += "\n\n"
    return done + [now.strip()] * bool(now.strip())


def test_chunks(spark):
    texts = ["One. Two! Three?\n\nFour five six. " * 6, "x" * 95, "", None, "a. " * 50]
    got = {}
    for r in chunking.chunk_text(spark.createDataFrame(list(enumerate(texts)), "project_id int, text string"), most=40).orderBy("project_id", "idx").collect():
        got.setdefault(r.project_id, []).append(r.text)
        assert r.id == f"{r.project_id}_chunk{r.idx + 1:03d}"
    assert got == {k: c for k, t in enumerate(texts) if (c := plain_chunks(t, 40))}
    cuts = chunking.cursor_cuts(spark.createDataFrame([(1, "ab. " * 30), (2, None)], "project_id int, text string"), limit=20).collect()
    assert all(len(r.text) <= 20 for r in cuts) and [r.text for r in cuts if r.project_id == 2] == [""]


def test_logs(spark):
    raw = spark.createDataFrame([("[2024-05-01 10:00:00 UTC] [ERROR][app] boom",), ("odd",)], "value string")
    rows = logs.parse_log(raw).collect()
    assert (rows[0].level, rows[0].source, rows[0].message, rows[1].level) == ("ERROR", "app", "boom", None)
    fields = logs.python_dict_fields(spark.createDataFrame([("{'a': None, 'b': True}",)], "message string"), "a string, b boolean").first().fields
    assert fields.a is None and fields.b is True


def test_projects(spark):
    state = spark.createDataFrame([("p", 0, "DONE", 0), ("p", 1, "NEW", 0), ("p", 2, "NEW", 0)], "project_id string, idx int, status string, committed_index int")
    assert [r.idx for r in projects.pending(projects.mark_done(state, state.filter("idx = 1"))).collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.extract_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "é" and rows["b.docx"].error.startswith("BadZipFile")
    assert readers.read_catalog(spark, str(tmp_path / "none.json")).count() == 1
    assert {r.name for r in writers.append_names(spark.createDataFrame([("Ann",)], "name string"), spark.createDataFrame([("ann",), ("Bo",)], "name string")).collect()} == {"Bo"}


def test_prose_plan_and_stream(spark, tmp_path):
    stories = spark.createDataFrame([(1, 'Ilse smiled. "Come in," she said. "Why?" Tobias asked.')], "story_id long, text string")
    cast = spark.createDataFrame([(1, 0, "Ilse", "F"), (1, 1, "Tobias", "M")], "story_id long, ord int, name string, gender string")
    lines = plans.prose_to_lines(stories, cast).orderBy("line_no").collect()
    assert [r.character for r in lines] == ["Ilse", "Ilse", "Ilse", "Tobias", "Tobias"] and all(len(set(r.emotions)) == 2 for r in lines)
    split.split_lines(stories).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(split.split_lines(stories).schema).parquet(str(tmp_path / "in"))
    q = streams.stream_speakers(stream, [("Ilse", "F"), ("Tobias", "M")], patience_ms=500).writeStream.format("memory").queryName("told").outputMode("append").start()
    for _ in range(120):
        if spark.table("told").count() == 5:
            break
        time.sleep(0.5)
    q.stop()
    assert [r.character for r in spark.table("told").orderBy("line_no").collect()] == ["Ilse", "Ilse", "Ilse", "Tobias", "Tobias"]  # the last line too


def test_speakers_keep_every_row(spark):
    """Rows without a story and rows that repeat a line number come back once each, with their own columns."""
    rows = [(1, 0, "Ilse smiled.", "narration", 7), (1, 1, "Go.", "dialogue", 8), (1, 1, "Stay.", "dialogue", 9), (None, 0, "Rain.", "narration", 5), (None, 0, "Snow.", "narration", 6)]
    lines = spark.createDataFrame(rows, "story_id int, line_no int, text string, type string, own int").withColumns({"raw": F.col("text"), "attribution": F.lit(None).cast("string"), "tags": F.array("type")})
    cast = spark.createDataFrame([(1, 0, "Ilse", "F"), (None, 0, "Tobias", "M"), (9, 0, "Ada", "F")], "story_id long, ord int, name string, gender string")
    found = speaker_blocks.detect_speakers(lines, cast)
    assert sorted((r.own, r.character, r.tags[0]) for r in found.collect()) == [(5, "Narrator", "narration"), (6, "Narrator", "narration"), (7, "Ilse", "narration"), (8, "Ilse", "dialogue"), (9, "Ilse", "dialogue")]
    assert speaker_blocks.detect_speakers(lines.limit(0), cast).count() == 0


def test_window_path_equals_fold(spark):
    """Where only named narration carries on, the window gives what the fold gives."""
    texts = ["Ilse's bag fell.", "Quiet followed.", "Tobias's dog barked.", "Night came."]
    rows = [(1, k, t, "narration", t, None) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "story_id long, line_no int, text string, type string, raw string, attribution string")
    cast = spark.createDataFrame([(1, 0, "Ilse", "F"), (1, 1, "Tobias", "M")], "story_id long, ord int, name string, gender string")
    fold = speaker_blocks.detect_speakers(lines, cast).orderBy("line_no")
    window = speakers.carry_subject(lines.withColumn("e", F.nullif(F.regexp_extract("text", "(Ilse|Tobias)", 1), F.lit(""))), "e").orderBy("line_no")
    assert [r.character for r in fold.collect()] == [r.carried for r in window.collect()]
