"""The filter audit against a replay document by document."""

import random
from collections import Counter
from itertools import permutations

from talespark.llm.filter_audit import audit_filters

SEPARATED = str.maketrans("\t\n\x0b\x0c\r", "     ")


def by_hand(docs, labels):
    smallest = {}
    for one, text, _, *_ in docs:
        if one is not None:
            smallest[text or ""] = min(one, smallest.get(text or "", one))
    flags = []
    for one, text, part, *_ in docs:
        text = text or ""
        words = [w for w in text.translate(SEPARATED).split(" ") if w]
        failed = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        failed += "D" * any(c in "#$%&*|" for c in text) + "E" * (one is not None and text in smallest and one > smallest[text])
        own = [row for row in labels if row[0] == one and one is not None]
        flags.append((part or "", failed, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in flags}:
            left = [f for f in flags if f[0] == part]
            for step, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                failing = [f for f in flags if f[0] == part and letter in f[1]]
                shapley[part, letter] += len(gone)
                out[part, order, step + 1] = (len(left), len(gone), len(failing) - len(gone), sum(f[1] == letter for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {(*key, *value, shapley[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


def test_against_a_replay(spark):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(400)] + ["Été", "naïve", "a b"]
    texts = [None, "", " \n\t", "A B", "x" * 100_000, " ".join(draw.choices(words, k=100_000))]
    texts += [draw.choice(" \n\t").join(draw.choices(words[: draw.choice([3, 90, 400])], k=draw.choice([150, 199, 200, 201, 260]))) + draw.choice(["", "", " #", " | ", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2]) for _ in range(60)]
    texts += [texts[9]] * 30 + ["", None, texts[5]]
    docs = [(k, t, None if k % 7 == 3 else f"s{k % 3}" if k % 5 else "", 1, "z") for k, t in enumerate(texts)]
    docs += [(3, "A B", "s1", 1, "z"), (3, "A B", "s1", 1, "z"), (None, "A B", "s1", 1, "z"), (None, "only without an id", "s1", 1, "z"), (900, "only without an id", "s1", 1, "z")]
    draw.shuffle(docs)
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, 90, 2)] + [(4, 1, 0), (None, 1, 1), (3, 1, 1)]
    got = audit_filters(spark.createDataFrame(docs, "doc_id long, text string, source string, part int, step string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(docs, labels)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit_filters(docs, labels)
    assert got.count() == 0 and got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
