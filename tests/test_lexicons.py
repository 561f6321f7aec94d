"""The lexicon's automaton against a regular expression for each keyword."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talespark.operators.lexicons import EDGES, Lexicon, lexicon_matches, lexicon_scores

NO = ("not", "never", "no", "don't")
LEXICON = {
    "firm": ["in control", "firm", "na na", "control in control"], "odd": ["co-op", "firm", "!", "c++", "-dash", "é", "straße", "sad", "a"], "none": [], "all": ["in", "in control now", "Firm", "_x_", "ſad", "K2"],
}


def scan(text, labels):
    """A pattern for each keyword; word borders where it begins or ends with a letter or digit."""
    out = []
    for label, words in labels.items():
        for word in sorted(dict.fromkeys(words), key=lambda w: (-len(w.split()), -len(w))):
            body = r"\s+".join(map(re.escape, word.split()))
            pattern = re.compile((r"\b" if word[0].isalnum() else "") + body + (r"\b" if word[-1].isalnum() else ""), re.I)
            for m in pattern.finditer(text or ""):
                tokens = list(re.finditer(r"\S+", text))
                at = next(k for k, t in enumerate(tokens) if t.start() <= m.start() < t.end())
                before = [t[0].lower().strip(EDGES) for t in tokens[max(0, at - 3) : at]]
                out.append((label, word, m.start(), m.end(), any(t in NO for t in before)))
    return out


def made(draw):
    words = ["in", "control", "firm", "Firm", "na", "sad", "SAD", "co-op", "no", "Never!", "don't", "(not)", "now", "a", "é", "STRASSE", "straße", "c++", "-dash", "_x_", "x_x_", "ſad", "K2", "İn", "ın", "é", "漢", "!", "firm.firm", "in control", ""]
    return "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\n", "\t", "", "-", ". ", " ", "\x1f"]) for _ in range(draw.randrange(40)))


def test_matches_equal_a_scan():
    draw, known, seen = random.Random(3), Lexicon(((k, tuple(v)) for k, v in LEXICON.items()), NO), 0
    for text in [None, "", " ", "na na na na", "in control in control in control", *(made(draw) for _ in range(1500))]:
        want = scan(text, LEXICON)
        assert [tuple(m) for m in known.matches(text)] == want, repr(text)
        scores = dict.fromkeys(LEXICON, 0)
        for label, word, *_, no in want:
            scores[label] += 0 if no else 2 if " " in word else 1
        assert known.scores(text) == list(scores.values())
        seen += len(want)
    assert seen > 5000


def test_a_large_lexicon_takes_one_pass():
    draw = random.Random(9)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(3, 9))) for _ in range(30_000)]
    known = Lexicon([("all", tuple(words))], NO)
    text = " ".join(draw.choices(words, k=2000) + draw.choices(["zz", "not"], k=500))
    have, tokens = set(words), text.split()
    assert known.scores(text)[0] == sum(t in have and not any(x == "not" for x in tokens[max(0, k - 3) : k]) for k, t in enumerate(tokens))


def test_columns(spark):
    rows = [(1, "Not at all firm, FIRM"), (2, None), (3, ""), (4, "x " * 200_000 + "in  control")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in df.select("id", lexicon_matches(F.col("text"), LEXICON, NO).alias("m"), lexicon_scores(F.col("text"), LEXICON, NO).alias("s")).collect()}
    assert {k: [tuple(m) for m in r.m] for k, r in got.items()} == {k: scan(t, LEXICON) for k, t in rows}
    assert got[1].s[0] == 1 and got[2].s == [0, 0, 0, 0] and got[4].m[0].start == 400_000
    assert df.select(lexicon_scores(F.col("text"), {}, NO).alias("s")).first().s == []


@pytest.mark.parametrize("text", ["é é", "x.é", "éin"])
def test_borders_know_letters_of_all_scripts(text):
    assert [tuple(m) for m in Lexicon([("l", ("é", "in"))], NO).matches(text)] == scan(text, {"l": ["é", "in"]})


def test_batches_follow_bytes(spark):
    """A worker is handed a few MB at a time, however many and long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    docs = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("sad x "), 1 << 18).alias("text"))
    counted = docs.select(F.size(lexicon_matches(F.col("text"), {"l": ["sad"]}, NO)).alias("n"))
    assert [r.n for r in counted.limit(2).collect()] == [1 << 18] * 2
    handed = F.arrow_udf(lambda texts: pa.array([len(texts)] * len(texts), pa.int64()), "long")
    assert max(r.n for r in docs.select(handed("text").alias("n")).collect()) <= 4
