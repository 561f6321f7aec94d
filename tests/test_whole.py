"""Registered queries read their whole input: against plain versions on small tables."""

import re

import duckdb

from talespark import queries as core
from talespark.data import load


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def told(sql, at):
    """The rows of a query's SQL over the tables of a folder."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return con.execute(sql).fetchall()


def test_emotion_queries_read_whole_texts(spark, tmp_path):
    tails = ["she whispered", "he snarled at last", "under my control", "a joyful joyful day", "never sad but nervous", "nothing", "please calm"]
    texts = ["plain words of a long tale " * 40 + t + " went on" * 30 for t in tails]
    at = folder(spark, tmp_path / "t", documents=([(13 * k, t) for k, t in enumerate(texts)], "doc_id long, text string"))  # ids whose phrase is empty
    run = lambda name: {r.line_id: r.asDict() for r in core.QUERIES[name](spark, at).collect()}
    table = load("emotion_rules")
    rules = {13 * k: next((f"{a},{b}" for p, a, b in table["rules"] if re.search(p, t.lower())), None) for k, t in enumerate(texts)}
    assert {k: r["labels"] for k, r in run("emotion_rules").items()} == rules and any(rules.values())
    cues = {13 * k: {s: sum(c in t.lower() for c in cs) for s, cs in table["cues"].items()} for k, t in enumerate(texts)}
    assert {k: {s: r[s] for s in table["cues"]} for k, r in run("emotion_context").items()} == cues
    felt = run("emotion_keywords")
    assert sum(felt[13 * 3][x] for x in table["lexicon"]) > 0 and all(felt[13 * 5][x] == 0 for x in table["lexicon"])
    assert {r.line_id for r in core.QUERIES["emotion_matches"](spark, at).collect()} >= {13 * 3}


def test_context_cues_are_found_within_marks(spark, tmp_path):
    """emotion_context reads letters and blanks: marks within a cue, or digits, do not hide it."""
    cues = load("emotion_rules")["cues"]
    texts = [f"so {c[:2]}-{c[2:]} it went" for cs in cues.values() for c in cs if c.isalpha()]
    at = folder(spark, tmp_path / "t", documents=([(13 * k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.line_id: r.asDict() for r in core.QUERIES["emotion_context"](spark, at).collect()}
    plain = [re.sub("[^a-zA-Z ]", "", t).strip() for t in texts]
    assert {k: {s: r[s] for s in cues} for k, r in got.items()} == {13 * k: {s: sum(c in t for c in cs) for s, cs in cues.items()} for k, t in enumerate(plain)}
    assert all(any(r[s] for s in cues) for r in got.values())


def test_context_cues_that_hold_marks_are_found(spark, tmp_path):
    """emotion_context also reads texts as they are: every cue is found as it is written, and the SQL says the same of odd texts."""
    cues = load("emotion_rules")["cues"]
    texts = [f"Go,\n{c.upper()}; 1" for cs in cues.values() for c in cs] + ["a \u212aiss", "a k\u0130ss", "mi\u0130ne", "1 al-most", "you're", "mine", "", None]
    at = folder(spark, tmp_path / "t", documents=([(13 * k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.line_id: r.asDict() for r in core.QUERIES["emotion_context"](spark, at).collect()}
    low = [[(t or "").lower(), re.sub("[^a-zA-Z ]", "", t or "").lower()] for t in texts]
    assert {k: {s: r[s] for s in cues} for k, r in got.items()} == {13 * k: {s: sum(any(c in t for t in ts) for c in cs) for s, cs in cues.items()} for k, ts in enumerate(low)}
    assert got[13 * texts.index("Go,\nYOU'RE MINE; 1")]["dominance"] == 2
    assert sorted(tuple(r.values()) for r in got.values()) == sorted(told(core.SQL["emotion_context"], at))


def test_feminine_cues_are_found_beside_marks(spark, tmp_path):
    """feminine_cues reads letters and blanks: a word beside a mark is one between blanks."""
    texts = ["it was her, then", "so (she) went", "wife!", "a pe-t", "the sheet", "1said 2it"]
    at = folder(spark, tmp_path / "t", documents=([(13 * k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.line_id // 13: (r.feminine, r.attributive) for r in core.QUERIES["feminine_cues"](spark, at).collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, True)}


def test_feminine_cues_within_marks_are_found(spark, tmp_path):
    """feminine_cues also reads texts as they are: possessives, and openings that a mark ends; the SQL says the same of odd texts."""
    texts = ["Ann's voice rose", "Ann whined.Then on", "whined\nthe door", "Zo\u00e9's voice", "\u00c9lan whined", "Ann's voices", "Ann whined2", "out on", "a so\u0130d", "\u00a0WH\u0130NED", "a \u017foon", "wh\u0131ned", "pe\u0130t", "\u212aitten", "Ann\u0301 whined\u0301", "wh\u0130\u0307ned", "(she) whined"]
    at = folder(spark, tmp_path / "t", documents=([(13 * k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.line_id // 13: (r.feminine, r.attributive) for r in core.QUERIES["feminine_cues"](spark, at).collect()}
    assert {k for k in range(8) if got[k][1]} == {0, 1, 2, 3, 4, 6}  # digits fall in the letters
    assert got[13] == (True, False) and got[16] == (True, True) and not any(got[k][0] for k in range(8))
    assert sorted((13 * k, *r) for k, r in got.items()) == sorted(told(core.SQL["feminine_cues"], at))


def test_scripts_hold_every_line_of_a_message(spark, tmp_path):
    rows = [(1, 0, "user", "first\nsecond *crash* third"), (1, 1, "Zoe", "a\n\nb"), (1, 2, "user", "go\nnow"), (1, 3, "user", "in\nout"), (1, 4, "user", "hidden\nnote"), (1, 5, "user", "\nlate")]
    at = folder(spark, tmp_path / "t", conversations=(rows, "conv_id long, turn long, role string, text string"))
    run = lambda name: core.QUERIES[name](spark, at).collect()
    got = {r.line_no: r for r in run("script_parse")}
    assert {k: " ".join(r.text.split()) for k, r in got.items()} == {0: "first second third", 1: "a b", 2: "go now", 3: "in out", 5: "late"}
    assert {r.line_no for r in run("script_strict")} == {0, 5} and {r.total_lines for r in run("line_totals")} == {6}
    assert {(r.character, r.uses) for r in run("character_usage")} == {("user", 2), ("Zoe", 1), ("Bob said", 1), ("Ann", 1)}
    assert [" ".join(r.text.split()) for r in run("voice_sequence") if r.line_no == 0 and r.type == "speech"] == ["first second third"]
    assert [r.line_no for r in run("missing_voices")] and "second" in run("formatted_script")[0].script


def test_direct_names_search_whole_texts(spark, tmp_path):
    rows = [(1, "word " * 300 + "the end"), (2, "wort " * 300 + "und mehr"), (3, "other " * 100), (4, None)]
    at = folder(spark, tmp_path / "t", documents=(rows, "doc_id long, text string"))
    assert {r.doc_id: r.name for r in core.QUERIES["direct_names"](spark, at).collect()} == {1: "The", 2: "und", 3: None, 4: None}


def test_name_map_knows_every_customer(spark, tmp_path):
    known = [(k, f"Customer#{k:04d}") for k in range(60)] + [(100, "Ann Lee"), (101, "Bo Leeds"), (102, "Marianne Hill")]
    users = ["Supplier#0055", "Lee", "Hill#Zed", "arian", "Nobody", "Ann#Lee"]
    at = folder(spark, tmp_path / "t", customer=(known, "c_custkey long, c_name string"), supplier=([(u,) for u in users], "s_name string"))
    entries = {n.lower().replace("#", " ") for _, n in known}
    want = {}
    for u in users:
        norm = u.lower().replace("#", " ")
        scored = []
        for part, v in [(0, norm)] + [(1, t) for t in norm.split()]:
            for e in (e for e in entries if v in e):
                tokens = e.split()
                scored.append((part * 10 + (0 if e == v else 1 if v in tokens else 2 if any(t.startswith(v) for t in tokens) else 3), -len(e), e))
        if scored:
            want[u] = min(scored)[2]
    assert {r.name: r.canonical for r in core.QUERIES["name_map"](spark, at).collect()} == want and want["Supplier#0055"] == "customer 0055" and want["Lee"] == "ann lee"


def test_name_map_broadcasts_nothing_posted(spark, tmp_path, monkeypatch):
    """What is posted of a small file of names is many times its size: it must not pass through the driver."""
    from talespark.operators import catalog

    plans, cut = [], catalog.cut
    monkeypatch.setattr(catalog, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    at = folder(spark, tmp_path / "t", customer=([(k, f"Customer#{k:09d}") for k in range(500)], "c_custkey long, c_name string"), supplier=([(f"Supplier#{k:09d}",) for k in range(40, 600, 40)], "s_name string"))
    assert {r.name: r.canonical for r in core.QUERIES["name_map"](spark, at).collect()} == {f"Supplier#{k:09d}": f"customer {k:09d}" for k in range(40, 500, 40)}
    posted = [p for p in plans if "Generate" in p and "Join" in p]
    assert posted and any("SortMergeJoin" in p for p in posted) and "BroadcastHashJoin" not in plans[1]
