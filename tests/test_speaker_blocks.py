"""Speakers by blocks against the fold over whole stories: three modes, casts of many kinds, blocks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from talespark.operators.speaker_blocks import START, Name, State, _numbered, all_kinds, applied, composed, detect_speakers, kind_of
from talespark.operators.speakers import OUTSIDER, Cast, Fold

SHAPE = "story_id long, line_no long, text string, type string, raw string, attribution string, block int, at string"
CASTS = [
    [("Ann Lee", "F"), ("Bob", "M"), ("Cyd", "U")], [("Ann Lee", "F")], [("Bob", "M"), ("Dan", "M")], [], [("Ann Lee", "F"), ("Eve", "F"), ("Bob", "M")], [("narrator", "F"), ("Bob", "M")], [("Cyd", "U")],
]
CATALOG = [("Zoe", "F"), ("Max", "M")]
PLAIN = ["The rain went on.", "Quiet.", "Stay here.", "Nobody came.", None, "", "  "]
TOLD = ["Ann Lee looked up.", "Bob's coat was wet.", "She nodded.", "He left.", "Her hand shook.", "Bob and Ann Lee met.", "said Bob", "I went out.", "Zoe waited.", "Max said nothing.", "The girl laughed.", "I know my way.", "Cyd whispered.", "Dan, asked", "A. L. came"]
SAID = [None, None, None, "Bob said.", "she whispered.", "he asked.", "I said.", "said Zoe", "said Ann Lee"]


def story(draw, number, lines, rate):
    out = []
    for k in range(lines):
        text = draw.choice(TOLD) if draw.random() < rate else draw.choice(PLAIN)
        kind = draw.choice(["narration", "dialogue", "dialogue", "attribution", None])
        said = draw.choice(SAID) if kind == "dialogue" and draw.random() < rate else None
        out.append((number, k, text, kind, draw.choice([text, f'"{text}" {said or ""}', None]), said, 7, "x"))
    return out


def by_hand(rows, cast, options):
    fold = Fold(Cast([(n, g) for n, g in cast], CATALOG), **options)
    keys = ("text", "type", "raw", "attribution")
    lines = [dict(zip(keys, r[2:6])) for r in rows]
    return [(r[0], r[1], *fold.step(line, after)) for r, line, after in zip(rows, lines, [*lines[1:], None])]


@pytest.mark.parametrize("options, size", [({"mode": "generic"}, 1), ({"mode": "generic"}, 4), ({"mode": "strict", "auto_assign": False}, 3), ({"mode": "strict"}, 90), ({"mode": "aggressive"}, 2), ({"mode": "aggressive", "initials": False}, 7)])
def test_blocks_equal_the_fold(spark, options, size):
    draw = random.Random(str(options) + str(size))
    rows, want, members = [], [], []
    for number in range(24):
        cast = CASTS[number % len(CASTS)]
        mine = story(draw, None if number == 23 else number, draw.choice([1, 2, 5, 40, 150]), draw.choice([0.02, 0.2, 0.8]))
        rows += mine
        members += [(number, k, n, g) for k, (n, g) in enumerate(cast)] if number != 23 else []
        want += by_hand(mine, cast if number != 23 else [], options)
    draw.shuffle(rows)
    lines = spark.createDataFrame(rows, SHAPE).repartition(3)
    cast = spark.createDataFrame([*members, (None, 0, "Bob", "M"), (99, 0, "Bob", "M")], "story_id int, ord int, name string, gender string")
    got = detect_speakers(lines, cast, catalog=CATALOG, block_lines=size, **options)
    assert got.columns == [*lines.columns, "character", "candidates"]
    found = sorted(((r.story_id, r.line_no, r.character, r.candidates) for r in got.collect()), key=str)
    assert found == sorted(want, key=str) and {r[2] for r in want} > {"Bob", "Narrator", "Ambiguous"}


def test_one_long_story_lies_in_many_parts(spark):
    draw = random.Random(3)
    rows = story(draw, 1, 30_000, 0.001)
    lines = spark.createDataFrame(rows, SHAPE).repartition(4)
    got = detect_speakers(lines, CASTS[0], "strict", block_lines=100).withColumn("part", F.spark_partition_id())
    found = sorted((r.line_no, r.character) for r in got.collect())
    assert found == [(r[1], r[2]) for r in by_hand(rows, CASTS[0], {"mode": "strict"})]
    assert detect_speakers(lines.limit(0), CASTS[0]).count() == 0
    never_null = lines.limit(3).withColumns({"type": F.lit("narration"), "text": F.lit("Bob."), "raw": F.lit("Bob.")})
    assert {r.character for r in detect_speakers(never_null, CASTS[0]).collect()} == {"Bob"}


def test_effects_compose_associatively():
    """Random effects that only name what a block can name: known names, and those at its head."""
    draw, kinds, bob = random.Random(1), all_kinds("strict"), Name("bob", "M", True)

    def end(head):
        name = draw.choice([bob, head.subject if isinstance(head.subject, Name) else bob])
        return State(*draw.choice([(None, None), ("Narrator", None), ("Narrator", "Narrator"), ("Narrator", OUTSIDER), ("Narrator", name), (name, name)]), draw.randrange(4))

    for _ in range(20):
        a, b, c = ({kind_of(k): end(k) for k in kinds} if draw.random() < 0.8 else State(bob, bob, 2) for _ in range(3))
        assert composed(composed(a, b), c) == composed(a, composed(b, c))
        assert applied(composed(a, b), START) == applied(b, applied(a, START))


def test_raw_that_is_the_text_is_kept_once(spark):
    """What is written, sorted and handed to Python holds such a text once; all columns come back as they were."""
    rows = [(1, 0, "Bob.", "narration", "Bob.", None, 7, "x"), (1, 1, "Go.", "dialogue", '"Go."', None, 7, "x"), (1, 2, None, "dialogue", None, None, 7, "x"), (1, 3, "Stay.", "dialogue", None, None, 7, "x"), (1, 4, None, "dialogue", "Ann.", None, 7, "x")]
    lines = spark.createDataFrame(rows, SHAPE)
    kept = {r.row.line_no: (r.row.raw, r.same) for r in _numbered(lines).collect()}
    assert kept == {0: (None, True), 1: ('"Go."', False), 2: (None, False), 3: (None, False), 4: ("Ann.", False)}
    assert sorted((tuple(r)[:8] for r in detect_speakers(lines, CASTS[0], "strict").collect()), key=lambda r: r[1]) == rows
