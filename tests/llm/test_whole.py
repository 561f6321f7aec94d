"""Operators do the whole job: cases that a shorter form of each would lose."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from talespark.llm import licenses, nearcopies, ordinal, quotes, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("bucket", [4096, 3])
def test_near_copies_against_brute_force(spark, bucket):
    draw = random.Random(7)
    texts = []
    for k in range(40):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 60, 300]))]
        texts.append(" ".join(words))
        for edits in range(draw.choice([0, 1, 6])):
            other = list(words)
            for _ in range(edits * len(words) // 100):
                other[draw.randrange(len(other))] = f"v{draw.randrange(3000)}"
            texts.append(" ".join(other).upper() if edits == 2 else " ".join(other))
    texts += ["", None, " \n"]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    sets = {i: shingles(t or "") for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in range(a):
            either = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / either if either else 1) >= 0.8 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nearcopies.near_copies(docs, bucket=bucket)
    assert dict(map(tuple, got.collect())) == root and len(set(root.values())) < len(root) - 20
    if bucket == 4096:
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(root.values())


def test_near_copies_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "c"), (3, "c")], "doc_id long, text string")
    assert sorted(map(tuple, nearcopies.near_copies(docs).collect()), key=str) == sorted([(None, None), (None, 3), (3, 3), (3, 3)], key=str)
    assert nearcopies.near_copies(docs.limit(0)).count() == 0 and nearcopies.one_per_group(docs).count() == 4


def test_pipeline_links_by_fingerprints_and_by_shingles(spark):
    """Of texts within 4 bits, but less than 0.8 alike, and of texts 0.8 alike, but further than 4 bits, one stays."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(9000)}" for _ in range(120)]
    near = far = None
    for k in range(4000):
        other = list(base)
        for at in range(3, 120, draw.choice([17, 21, 60])):
            other[at] = f"v{draw.randrange(9000)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        bits = (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(other))).bit_count()
        like = len(a & b) / len(a | b)
        near = near or (like < 0.8 and bits <= 4 and other)
        far = far or (like >= 0.8 and bits > 4 and other)
        if near and far:
            break
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.one_per_group(docs).collect()} == {1, 2, 4}
    assert {r.doc_id for r in simhash.one_per_group(docs).collect()} == {1, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 4}


def test_quotation_of_100000_lines(spark):
    lines = [f"line {k}" for k in range(100_000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "a", "\n".join("> " + x for x in lines) + "\nseen"), (1, 2, "u", ">" * 100_000 + " deep\n> seen\nyes")]
    got = {r.turn: r for r in quotes.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].text, got[1].n_quotes, got[1].parent_turn, got[1].n_linked) == ("seen", 1, 0, 100_001)
    assert (got[2].text, got[2].n_quotes, got[2].parent_turn) == ("yes", 2, 1)


def test_licenses_within_lines(spark):
    texts = [
        "Copyright 2020 Acme Inc. Released under the MIT License.", "Copyright (c) 2021 Ann Lee. All rights reserved.",
        "One sentence of six words before. This work is licensed under the GNU General Public License, version 3. And more after it.",
        "one\n\ntwo released under the\nMIT License three", "all rights are reserved by nobody",
    ]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.license, r.dice, r.line, r.licenses) for r in sorted(got)] == [("MIT", 1.0, 0, "MIT"), ("all-rights-reserved", 1.0, 0, "all-rights-reserved"), ("GPL-3.0", 1.0, 0, "GPL-3.0"), ("MIT", 1.0, 2, "MIT"), (None, None, None, "")]


def test_licenses_against_every_passage():
    draw = random.Random(5)
    templates = [("a", "x y z x y w"), ("b", "y z"), ("c", "p q r s t u v p q")]
    scanner = licenses.Scanner(templates, 0.8)
    for _ in range(300):
        words = [draw.choice("xyzwpqrstuv") for _ in range(12)]
        for name, text in templates:
            if draw.random() < 0.5:
                at = draw.randrange(len(words))
                words[at:at] = [w for w in text.split() if draw.random() < 0.95]
        text = "".join(w + draw.choice([" ", " ", "\n"]) for w in words)
        want = {}
        for name, known in templates:
            grams = Counter(zip(known.split(), known.split()[1:]))
            scores = [licenses.dice(Counter(zip(words[i:j], words[i + 1 : j])), grams) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
            if max(scores) >= 0.8:
                want[name] = max(scores)
        assert {name: score for score, _, name, _ in scanner.scan(text)} == want


def test_ordinal_hot_id_is_one_example(spark):
    draw = random.Random(3)
    texts = [(k, f"{'insult ### insult' if k % 2 else 'fine calm words'} " + " ".join(draw.choices("abcdefgh", k=5))) for k in range(120)]
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k, _ in texts], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    hot = plain.union(spark.createDataFrame([(1, f"insult {k}") for k in range(500)], "doc_id long, text string"))
    kept = {r.doc_id: r.kept for r in ordinal.classify(plain, ordinal.train(hot, labels, bound=120)).collect()}
    assert all(kept[k] == (k % 2 == 0) for k in kept if k != 1)
