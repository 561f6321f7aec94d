"""Names in prose, literal gates, sources and sinks, and what SQL does not state."""

import random
import re

from pyspark.sql import functions as F

from talespark.data import load
from talespark.functions import text as T
from talespark.operators import catalog, emotions, names, speakers
from talespark.sources import readers, writers


def test_seeds_lose_no_match():
    """Whatever a rule's pattern matches holds one of its literals."""
    draw = random.Random(1)
    words = re.findall(r"[a-z]+", " ".join(p for p, _, _ in load("emotion_rules")["rules"]).replace(r"\b", " ").replace(r"\s", " "))
    for _ in range(4000):
        text = "".join(draw.choice(words) + draw.choice([" ", "ed ", "s ", "d ", "?", "!", "  "]) for _ in range(6))
        for pattern, _, _ in load("emotion_rules")["rules"]:
            if (literals := emotions.seeds(pattern)) and re.search(pattern, text):
                assert any(x in text for x in literals), (pattern, text)
    assert emotions.seeds("a*b?") == set() and emotions.seeds("(ab|c*)") == set() and emotions.seeds("(ab|cd)+e") in ({"e"}, {"ab", "cd"})


def test_keyword_phrases_and_negations(spark):
    lexicon = {"firm": ["in control", "firm"], "odd": ["co-op"], "none": []}
    texts = ["in control, in  control", "never in control", "not at all in control", "no it is not so firm", "firm-firm firm", "confirm", "IN CONTROL", "the co-op", "in", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", emotions.keyword_scores(F.col("text"), lexicon).alias("s")).orderBy("id").collect()
    assert [tuple(-x["less"] for x in r.s) for r in rows] == [(4, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (3, 0, 0), (0, 0, 0), (2, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0)]


def test_emotion_matches_against_a_scan(spark):
    lexicon = load("emotion_rules")["lexicon"]
    text = "She was not angry, never sad; joyful! Joyful and no longer calm"
    rows = emotions.explain_emotions(spark.createDataFrame([(1, text), (2, None)], "line_id int, text string")).orderBy("line_id").collect()
    want = set()
    for label, words in lexicon.items():
        for w in words:
            for m in re.finditer(rf"\b{w}\b", text, re.I):
                before = [t.strip(".,!?;:").lower() for t in text[: m.start()].split()][-3:]
                want.add((label, w, m.start(), m.end(), any(t in ("not", "never", "no") for t in before)))
    assert {tuple(m) for m in rows[0].matches} == want and want and rows[1].matches == []


def test_name_candidates(spark):
    text = "Mara Vale walked in. Then Mara Vale sat. After lunch Otto said nothing. Otto? The Harbour was shut. Joost van Dam's coat fell; asked Pim. Mother came. Zed. old bela bela!"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "story_id long, text string")
    known = spark.createDataFrame([("Bela", 0), ("Zed", 1), ("Mother", 2), ("Nobody", 3)], "display string, ord int")
    got = sorted((r.place, r.name, r.uses) for r in names.name_candidates(rows, known).collect())
    assert got[0][1:] == ("Bela", 2) and got[1][1:] == ("Zed", 1)
    assert {n for _, n, _ in got} == {"Bela", "Zed", "Mara Vale", "Otto", "Pim"}
    assert [p for p, _, _ in got] == list(range(1, len(got) + 1))


def test_contexts():
    assert names.in_context("Otto", "so Otto  SAID") and names.in_context("Otto", "said\n otto.") and names.in_context("Otto", "Otto's hat") and names.in_context("Otto", "Otto, whispered") and names.in_context("Otto", "OTTO nodded")
    assert not names.in_context("Otto", "Otto went; Ottoman's hat") and not names.in_context("Otto", "said Ottoman") and not names.in_context("Otto", "nodded Otto")


def test_looks_like_name(spark):
    cases = {"Ann": True, "Joost van Dam": True, "ann": False, "The Captain": False, "Mother Ann": False, "A B C D E": False, "": False, None: False, "O'Hara-Lee": True, "42": False}
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", names.looks_like_name(F.col("name")).alias("x")).collect()
    assert {r.name: r.x for r in rows} == cases == {k: names._is_name(k or "") for k in cases}


def test_model_names_and_preferences(spark):
    rows = [(1, k, n, "U") for k, n in enumerate(["Ann", "ann", "ANN!", "the dog", "Bo", None])] + [(2, k, f"Name{chr(65 + k)}", "U") for k in range(20)]
    got = names.model_names(spark.createDataFrame(rows, "story_id long, ord int, name string, gender string")).collect()
    assert sorted(r.name for r in got if r.story_id == 1) == ["Ann", "Bo"] and sum(r.story_id == 2 for r in got) == 12
    offered = spark.createDataFrame([(["zed", "Ann!", "Bo"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in offered.select(speakers.preferred(F.col("c"), ["bo", "ann"])).collect()] == ["Ann!", None, None]
    assert [r[0] for r in offered.select(speakers.preferred(F.col("c"), [])).collect()] == [None] * 3


def test_map_names_by_parts(spark):
    known = [f"entry number {k}" for k in range(50)] + ["mara lind", "lindgren", "a b"]
    users = ["Mara", "indg", "ra li", "b", "zzz", "number 7", "Lind"]
    got = {r.name: r.canonical for r in catalog.map_names(spark.createDataFrame([(u,) for u in users], "name string"), spark.createDataFrame([(k,) for k in known], "name_norm string")).collect()}
    want = {}
    for u in users:
        norm, scored = u.lower(), []
        for part, v in [(0, norm)] + [(1, t) for t in norm.split() if t != norm]:
            for e in (e for e in known if v in e):
                t = e.split()
                scored.append((part * 10 + (0 if e == v else 1 if v in t else 2 if any(x.startswith(v) for x in t) else 3), -len(e), e))
        if scored:
            want[u] = min(scored)[2]
    assert got == want and got["indg"] == "lindgren"


def test_voice_mappings_and_scripts(spark, tmp_path):
    rows = spark.createDataFrame([("p", "Ann", "v1"), ("p", "Bo", "v2"), ("q", "Ann", None), (None, "x", "y")], "project string, character string, voice_id string")
    writers.write_voice_mappings(rows, str(tmp_path / "voices"))
    got = readers.read_voice_mappings(spark, str(tmp_path / "voices"))
    assert {tuple(r) for r in got.collect()} == {("p", "Ann", "v1"), ("p", "Bo", "v2"), ("q", "Ann", None)}
    (tmp_path / "z_voices.json").write_text('{\n "project_name": "z",\n "voice_mappings": {"Ann": "v9"}\n}')
    assert [tuple(r) for r in readers.read_voice_mappings(spark, str(tmp_path / "z_voices.json")).collect()] == [("z", "Ann", "v9")]
    writers.write_scripts(spark.range(300).select(F.col("id").alias("story_id"), F.lit("[A] (soft)(calm): x\ny").alias("script")), str(tmp_path / "scripts"), 4)
    back = spark.read.json(str(tmp_path / "scripts"))
    assert back.count() == 300 and back.select("bucket").distinct().count() == 4 and back.first().script == "[A] (soft)(calm): x\ny"


def test_text_functions(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(T.first_given(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert value(T.text_digest(F.lit(" \n "))) is None and value(T.text_digest(F.lit(" a "))) == value(T.text_digest(F.lit("a")))
    assert value(T.response_text(F.lit(None).cast("array<struct<content:array<struct<text:struct<value:string>>>>>"))) == ""
    assert value(T.bind(F.array(F.lit(1), F.lit(2)), lambda a: F.size(a) + a[1])) == 4


def test_documents_by_type_and_fonts(spark, tmp_path):
    cmap = b"begincmap 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0004> <0069> endbfrange endcmap"
    pdf = b"%PDF\n1 0 obj\nstream\n" + cmap + b"\nendstream\n2 0 obj\nstream\nBT <00010002> Tj [(a\\)b) -20 <0003>] TJ ET\nendstream\n"
    (tmp_path / "a.pdf").write_bytes(pdf)
    (tmp_path / "b.bin").write_bytes(pdf)
    (tmp_path / "c.xyz").write_bytes(b"plain")
    by = lambda df: {r.path.rsplit("/", 1)[1]: r.text for r in df.collect()}
    got = by(readers.extract_documents(spark, str(tmp_path)))
    assert got["a.pdf"] == "Hi a)bj" and got["c.xyz"] == "plain" and got["b.bin"].startswith("%PDF")
    paths = [r.path for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()]
    types = spark.createDataFrame([(p, "application/pdf") for p in paths if p.endswith(".bin")], "path string, mime string")
    assert by(readers.extract_documents(spark, str(tmp_path), types))["b.bin"] == "Hi a)bj"


def test_configs(spark, tmp_path):
    (tmp_path / "tags.json").write_text('{"calm": {"soft": "[soft]"}}')
    (tmp_path / "words.json").write_text('["said", "asked"]')
    (tmp_path / "bad.json").write_text("{{{")
    none = str(tmp_path / "none.json")
    assert [tuple(r) for r in readers.read_tags(spark, none, str(tmp_path / "tags.json")).collect()] == [("calm", "soft", "[soft]")]
    assert [r.word for r in readers.read_words(spark, str(tmp_path / "bad.json"), str(tmp_path / "words.json")).orderBy("ord").collect()] == ["said", "asked"]
    assert readers.read_word_map(spark, none).count() == 0 and readers.read_words(spark, none).count() == 0


def test_names_in_context_take_no_pattern_each(monkeypatch):
    """As a pattern for each name finds them, letters that are alike in any case included; but a text is folded once."""
    import random
    import re

    from talespark.operators import names

    def scan(name, text):
        for m in re.finditer(rf"\b{re.escape(name)}", text, re.I):
            head = text[: m.start()].rstrip()
            if names._AFTER.match(text, m.end()):
                return True
            if len(head) < m.start() and names._BEFORE.search(head[-16:]) and not re.match(r"\w", text[m.end() :]):
                return True
        return False

    draw, hits = random.Random(2), 0
    parts = ["Kim", "kim", "\u212aim", "K\u0130m", "K\u0131m", "Ann-Sue", "ANN-\u017fue", "said", "Asked", "'s", " ", " ", " ", "\n", ", ", "_", "x", "\u00e9", "smiled", ".", "Kim Lee", "KimKim"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        for name in ("Kim", "Ann-Sue", "Kim Lee"):
            assert names.in_context(name, text) == scan(name, text), (name, text)
            hits += names.in_context(name, text)
    assert hits > 100
    folds = []
    monkeypatch.setattr(names, "folded", lambda t: folds.append(t) or t.lower())
    text = " ".join(f"Zed{chr(97 + k)} went." for k in range(20))
    assert names.phrases_of(text) and folds.count(text) == 1
