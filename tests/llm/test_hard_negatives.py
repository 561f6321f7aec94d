"""Hard negatives against all products: ties, repeated rows, odd vectors, many groups and long digits."""

import random

import pytest
from pyspark.sql import functions as F

from talespark.llm.hard_negatives import mine_hard_negatives

SHAPE = "vec_id long, label int, embedding array<double>, row long, id string, score string"


def by_hand(rows, every, positives, k, scale=256):
    known = []
    for place, (one, label, v, *_) in enumerate(rows):
        if one is not None and label is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v):
            known.append((place, one, label, [int(scale * x // 1) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for place, one, label, v in known:
        if one % every:
            continue
        others = sorted((-dot(v, w), o, p, kind) for p, o, kind, w in known if p != place)
        for s, pos, *_ in [x for x in others if x[3] == label][:positives]:
            fits = [x for x in others if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(one, pos, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits[:k])]
    return sorted(out)


def made(n, width, spread, seed):
    draw = random.Random(seed)
    rows = [(k, draw.randrange(3), [draw.choice(spread) for _ in range(width)], 1, "x", "y") for k in range(n)]
    rows += [(k + n, draw.randrange(3), rows[7][2], 1, "x", "y") for k in range(n // 3)]  # one vector in a quarter of the rows
    rows += [(40, 1, rows[7][2], 1, "x", "y")] * 9 + [(20, 2, rows[7][2], 1, None, None)] * 2  # repeated ids, anchors among them
    rows += [(None, 1, [1.0] * width, 1, "x", "y"), (60, None, [1.0] * width, 1, "x", "y"), (80, 1, None, 1, "x", "y"), (100, 1, [None] + [1.0] * (width - 1), 1, "x", "y"), (120, 2, [float("nan")] * width, 1, "x", "y"), (140, 2, [float("inf")] * width, 1, "x", "y"), (160, 0, [0.5], 1, "x", "y"), (180, 0, [], 1, "x", "y")]
    return rows


@pytest.mark.parametrize("spread, enough, group_bytes", [([-0.5, 0.0, 0.25, 1.0], 1, 1 << 20), ([k / 977 for k in range(-200, 977)], 20, 200), ([k * 1e5 + 0.5 for k in range(-3, 60)], 2, 1 << 20)])
def test_against_all_products(spark, spread, enough, group_bytes):
    rows = made(150, 4, spread, enough)
    got = mine_hard_negatives(spark.createDataFrame(rows, SHAPE).repartition(3), every=20, positives=3, k=4, enough=enough, group_bytes=group_bytes)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 20, 3, 4)


def test_products_beyond_64_bits_stay_within(spark):
    rows = [(0, 1, [3e15, 1.0]), (1, 1, [3e15, 2.0]), (2, 2, [3e15, 2.0]), (3, 2, [0.0, 1.0]), (4, 1, [1e300, 1.0])]
    got = mine_hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {(r.positive_id, r.negative_id) for r in got} == {(1, 2), (4, 2)} and {r.positive_score for r in got} == {(1 << 63) - 1}


def test_empty(spark):
    got = mine_hard_negatives(spark.createDataFrame([], SHAPE))
    assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mine_hard_negatives(spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<double>"), label=F.lit(1)).count() == 0
