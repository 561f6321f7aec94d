"""The ten operators against plain versions, and on nulls, empty, long, tied and repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from talespark.llm import anchors, bpe, components, gsaca, licenses, mixing, mtree, ordinal, quality, quotes, repeats, simhash, url_rules
from talespark.llm.common import cut, slices

from . import plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
LONG = " ".join(rng.choice(VOCAB) for _ in range(9000))
SHARED = " ".join(rng.choice(VOCAB) for _ in range(80))


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


TEXTS = [None, "", " \n\t", "one", "Two words", LONG, LONG, prose(60), prose(60) + " " + SHARED + " " + prose(20), prose(5) + " " + SHARED + "\n" + prose(9), SHARED, "x" * 700, "é" * 300]
TEXTS += [SHARED + prose(30)] * 2 + [prose(20) + SHARED + prose(2) for _ in range(6)] + ["a b c d e f g", "A B C D E F G", "a b c a b c a b c", "# $ %\n# $ %\n\n \n# $ %"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with columns whose names the operators use themselves."""
    rows = [(k, t, None if k % 5 == 4 else f"s{k % 3}", None if k % 4 == 3 else "en", 7, "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, fp long, key string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices_bound_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * k for k in (10, 5000, 10, 10, 9000)]})
    parts = list(slices(batch, 0, 4000))
    assert sum(map(len, parts)) == 5 and all(len(p) == 1 or p.column(0).nbytes <= 4000 for p in parts)


# 1


def test_ordinal_learns_and_orders():
    good, bad, worst = ["fine calm words here"] * 60, ["fine ### words ###"] * 60, ["fine insult words here"] * 60
    texts = [f"{t} {prose(5)}" for t in good + bad + worst]
    grades = np.repeat([2, 1, 0], 60)
    model = ordinal.fit_ordinal([ordinal.features(t, 16) for t in texts], grades, 16)
    assert (np.diff(model.thresholds) > 0).all()
    expected = [model.tails(t).sum() for t in ("fine calm words here", "fine ### words ###", "fine insult words here")]
    assert expected[0] > expected[1] > expected[2] and (np.diff(model.tails("fine")) <= 0).all()
    for given, tails in (([1], (True, False)), ([0], (False, False)), ([2], (True, True)), ([0, 1] * 20, (None, False)), ([1, 2] * 20, (True, None)), ([0, 2] * 20, (None, None))):
        some = ordinal.fit_ordinal([ordinal.features(f"w{g} same", 16) for g in given], np.array(given), 16)
        for got, want in zip(some.tails("same"), tails):
            assert want is None or (got > 0.98 if want else got < 0.02)
    one = ordinal.fit_ordinal([ordinal.features("a", 16)], np.array([2]), 16)
    assert one.tails("a")[1] > 0.5 and ordinal.fit_ordinal([], np.zeros(0, np.int64), 16).tails(None)[0] > 0.5


def test_ordinal_maximises_the_likelihood():
    """The objective at the fit is no higher than at any point of a grid around it, computed plainly."""
    draw, words = random.Random(8), ["up", "down", "even"]
    texts = [" ".join(w for w in words if draw.random() < 0.5) for _ in range(150)]
    grades = np.array([min(2, max(0, ("up" in t.split()) - ("down" in t.split()) + draw.choice([0, 1, 1, 2]))) for t in texts])
    model = ordinal.fit_ordinal([ordinal.features(t, 12) for t in texts], grades, 12, l1=0.01, rounds=4000, step=0.01)
    places = {w: [k for k in ordinal.features(w, 12) if model.weights[k]] for w in words}

    def loss(weights, cuts):
        total = 0.0
        for t, g in zip(texts, grades):
            tail = [1.0, *(1 / (1 + math.exp(c - sum(weights[k] for k in ordinal.features(t, 12)))) for c in cuts), 0.0]
            total -= math.log(tail[g] - tail[g + 1])
        return total / len(texts) + 0.01 * sum(map(abs, weights.values()))

    at = {k: float(model.weights[k]) for t in texts for k in ordinal.features(t, 12)}
    best = loss(at, model.thresholds)
    assert places["up"] and best < loss(dict.fromkeys(at, 0.0), model.thresholds)
    for step in (-0.2, -0.05, 0.05, 0.2):
        assert all(loss({**at, k: at[k] + step}, model.thresholds) > best - 1e-4 for k in at)
        assert all(loss(at, model.thresholds + step * (np.arange(2) == j)) > best - 1e-4 for j in range(2))


def test_ordinal_without_good_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k % 3} words") for k in range(60)], "doc_id long, text string")
    for grades, kept in (([1], 0), ([0], 0), ([0, 1], 0), ([2], 60), ([], 60)):
        labels = spark.createDataFrame([(k, int(g == 2), int(g == 0)) for k in range(60 if grades else 0) for g in [grades[k % len(grades)]]], "doc_id long, quality int, toxic int")
        assert ordinal.keep_good(docs, ordinal.train(docs, labels)).count() == kept


def test_ordinal_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    even = F.col("doc_id") % 2 == 0
    model = ordinal.train(docs, labels.filter(even))
    met = ordinal.classify(docs, model).join(ordinal.graded(labels.filter(~even)), F.col("doc_id") == F.col("__id"))
    share = {r.grade: r.share for r in met.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[2] > 0.98 and share[1] < 0.1


def test_ordinal_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, labels)
    rows = ordinal.classify(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(r.kept is not None for r in rows)
    assert ordinal.classify(empty, model).count() == 0 and ordinal.train(empty, labels.limit(0)).thresholds.size == 2
    assert ordinal.keep_good(docs, model).columns == docs.columns


# 2


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> How are   you?\nFine thanks.\nAnd you?"), (1, 2, "u", "Bob wrote:\n> > How are you?\n> Fine thanks.\n> And you?\n\nGood."),
        (1, 3, "u", ">Hello there.\nnice"), (1, 3, "u", "dup"), (1, 4, "x", "a > b"), (2, 0, "u", None), (2, 1, "a", "> unknown\nyes"), (None, 1, "a", "> Hello"), (1, None, "a", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(3))
    got = {(r.conv_id, r.turn, r.text): r for r in quotes.format_conversations(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 1, "Fine thanks.\nAnd you?"].parent_turn == 0 and (got[1, 2, "Good."].root_turn, got[1, 2, "Good."].depth, got[1, 2, "Good."].place) == (0, 2, 2)
    assert (got[1, 3, "nice"].root_turn, got[1, 3, "nice"].depth, got[1, 3, "nice"].place) == (0, 1, 3) == (got[1, 3, "dup"].root_turn, got[1, 3, "dup"].depth, got[1, 3, "dup"].place)
    assert got[1, 4, "a > b"].parent_turn is None and got[2, 1, "yes"].n_quotes == 1 and got[2, 1, "yes"].parent_turn is None
    assert quotes.format_conversations(df.limit(0)).count() == 0


def test_quotes_have_no_deepest_level_and_no_longest_lead(spark):
    rows = [(1, 0, "u", "root"), (1, 1, "a", "> " * 12 + "root\n" + "Bob " * 200 + "wrote:\n> root\nok")]
    r = quotes.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("turn = 1").first()
    assert (r.text, r.n_quotes, r.n_linked, r.parent_turn) == ("ok", 2, 1, 0)
    levels = spark.createDataFrame([(">" * 12 + " a\n> b\n>> c",)], "text string").select(quotes.quoted(F.col("text")).alias("q")).first().q
    assert [tuple(x) for x in levels] == [(12, " a"), (1, " b"), (2, " c")]


def test_threads_against_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 4)
    draw = random.Random(9)
    parents = {(c, t): draw.choice([0, draw.randrange(t), t - 1]) for c in (1, 2) for t in range(1, 60) if draw.random() < 0.8}
    want = {}
    for c in (1, 2):
        below = {}
        for (d, t), p in sorted(parents.items()):
            if d == c:
                below.setdefault(p, []).append(t)
        for root in sorted({p for (d, _), p in parents.items() if d == c} - {t for d, t in parents if d == c}):
            ahead, place = [(root, 0)], 0
            while ahead:
                t, depth = ahead.pop()
                want[c, t] = (root, depth, place)
                place += 1
                ahead += [(x, depth + 1) for x in reversed(below.get(t, []))]
    got = quotes.threads(spark.createDataFrame([(*k, p) for k, p in parents.items()], "conv long, turn long, parent long"))
    assert {(r.conv, r.turn): (r.root, r.depth, r.place) for r in got.collect()} == want


def test_quotes_use_the_latest_source_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 4)
    rows = [(1, t, "same" if t % 6 == 0 else f"other {t}") for t in range(20)] + [(1, 20, "> same"), (1, 3, "> same")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {(r.turn, r.parent) for r in got} == {(20, 18), (3, 0)}


# 3


def test_suffix_arrays():
    g = np.random.default_rng(0)
    texts = [np.r_[g.integers(1, g.integers(2, 6), g.integers(0, 60)), 0] for _ in range(200)] + [np.r_[np.full(50, 3), 0], np.r_[np.tile([2, 1, 1], 20), 0], np.array([0])]
    got, at = gsaca.suffix_arrays(np.concatenate(texts), np.array([len(t) for t in texts])), 0
    for t in texts:
        assert (got[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        at += len(t)


def test_anchors_are_alike_in_equal_windows():
    g = np.random.default_rng(1)
    core = g.integers(97, 100, 200, np.uint8)
    a, b = (np.concatenate((g.integers(97, 123, n, np.uint8), core, g.integers(97, 123, 90, np.uint8))) for n in (333, 57))
    inside = [set(p - n for p in anchors.anchors(x, np.array([len(x)]), 200, 101)[0].tolist() if n <= p <= n + 99) for x, n in ((a, 333), (b, 57))]
    assert inside[0] & inside[1]


@pytest.mark.parametrize("group", [400, 2])
def test_repeats(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    want = plain.repeats(TEXTS)
    got = by_id(repeats.digest_repeats(docs))
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k in range(len(TEXTS))] == want
    assert repeats.digest_repeats(empty).count() == 0


def test_the_order_decides_all_but_whole_copies(docs, monkeypatch):
    """Without suffix sorting nothing goes but texts that repeat whole."""

    def nothing(batches):
        for _ in batches:
            yield from ()

    monkeypatch.setattr(repeats, "_sorted_spans", lambda width, span: nothing)
    monkeypatch.setattr(repeats, "_sorted_surroundings", nothing)
    got, copies = by_id(repeats.digest_repeats(docs)), Counter(TEXTS)
    for k, t in enumerate(TEXTS):
        size = len((t or "").encode())
        assert got[k].n_removed == (size if copies[t] > 1 and size >= 200 else 0)


@pytest.mark.parametrize("group, size", [(400, 1000), (3, 64)])
def test_lone_surroundings_do_not_repeat(monkeypatch, group, size):
    """Of surroundings of which half have one place, those with two come back, and no other."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "GROUP", group)
    g = np.random.default_rng(2)
    rows = np.unique(np.c_[g.integers(-40, 40, 5000), g.integers(-3, 3, (5000, 4))], axis=0)
    low = np.arange(len(rows)) * 2
    high = low + g.integers(0, 2, len(rows))
    table = pa.table({c: pa.array(x) for c, x in zip(("h", "l2", "l1", "r1", "r2", "low", "high"), (*rows.T, low, high))})
    got = [x for b in repeats._sorted_surroundings(iter(table.to_batches(size))) for x in b.to_pylist()]
    want = {(*map(int, r), int(a)) for r, a, b in zip(rows, low, high) if a != b}
    assert len(got) == len(want) > 1000 and {tuple(x.values()) for x in got} == want


def test_only_anchors_with_several_surroundings_are_cut_into_strings(spark, monkeypatch):
    """Inside a passage that two texts share all is decided by its surroundings; strings are asked for at its borders alone."""
    g = np.random.default_rng(5)
    draw = lambda n: "".join(map(chr, g.integers(97, 123, n)))
    passage, asked, decided = draw(3000), [], repeats._decided

    def seen(rows, span, keep):
        asked.extend(r.begin for r in rows.select("begin").collect())
        return decided(rows, span, keep)

    monkeypatch.setattr(repeats, "_decided", seen)
    texts = [draw(500) + passage + draw(500), draw(500) + passage + draw(700), draw(3000)]
    got = by_id(repeats.digest_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k in range(3)] == plain.repeats(texts)
    assert asked and all(b < 1000 or b > 3000 for b in asked)


def test_workers_get_few_texts_at_a_time(spark, monkeypatch, tmp_path):
    """Spark's own batches of 10000 rows or 64 MB stay in the executors' memory."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    from talespark.llm import common

    def seen(batch, *args):
        with open(f"{tmp_path}/sizes", "a") as f:
            f.write(f"{batch.nbytes}\n")
        return common.slices(batch, *args)

    monkeypatch.setattr(repeats, "slices", seen)
    g = np.random.default_rng(6)
    texts = [bytes(g.integers(97, 123, 4000, np.uint8)).decode() for _ in range(3000)]
    rows = spark.createDataFrame([(k, t + texts[0][:300]) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = by_id(repeats.digest_repeats(rows))
    for k in range(len(texts)):  # letters beside the passage may happen to be alike
        assert got[k].n_spans == 1 + (k == 0) and 0 <= got[k].n_removed - 300 * got[k].n_spans < 12
    sizes = [int(x) for x in (tmp_path / "sizes").read_text().split()]
    assert sum(sizes) > 12_000_000 and max(sizes) < 5 << 20


def test_hash_tables_of_long_texts_are_not_kept():
    g = np.random.default_rng(7)
    data = g.integers(0, 256, 2_000_000, np.uint8)
    anchors._powers.cache_clear()
    long = anchors.Hashes(data, 1)
    assert anchors._powers.cache_info().currsize == 0
    start = np.array([0, 5, 1_999_000, 1_999_999, 2_000_000])
    end = np.minimum(start + 1000, len(data))
    parts = [anchors.Hashes(data[a:b], 1) for a, b in zip(start, end)]
    assert [int(x) for x in long.of(start, end)] == [int(h.of(np.array([0]), np.array([b - a]))[0]) for h, a, b in zip(parts, start, end)]
    assert anchors._powers.cache_info().currsize == 1 and parts[0].up.nbytes <= 2 << 20


def test_suffix_arrays_of_runs():
    """Chains of previous smaller suffixes of one symbol's run are followed in few rounds."""
    text = np.r_[np.full(200_000, 3), 0]
    assert gsaca.suffix_arrays(text, np.array([len(text)])).tolist() == list(range(200_000, -1, -1))


CLASHES = "k1 k2 spans text_ left word bits row end weight room epoch __full __source __key __word __k1 tokens h c own low high digest component_id gone __gone tail kept".split()


@pytest.fixture(scope="module")
def clashing(docs):
    """The texts with every column name that an operator uses within."""
    return docs.select("doc_id", "text", "source", "lang", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def test_strip_repeats_with_clashing_names(docs, clashing):
    want, got = by_id(repeats.strip_repeats(docs)), by_id(repeats.strip_repeats(clashing))
    assert all(got[k].text == want[k].text and all(got[k][c] == j for j, c in enumerate(CLASHES)) for k in got) and len(got) == len(TEXTS)
    assert repeats.strip_repeats(clashing).columns == clashing.columns and repeats.strip_repeats(clashing.limit(0)).count() == 0


def test_strip_repeats_keeps_text(docs):
    got = by_id(repeats.strip_repeats(docs))
    assert got[0].text is None and got[5].text == "" and got[4].text == "Two words" and got[7].text == TEXTS[7]
    assert all(SHARED not in (r.text or "") for r in got.values()) and set(got[1].asDict()) == set(docs.columns)


# 4


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES[[n for n, _ in licenses.TEMPLATES].index("MIT") + 1][1]
    words = mit.split()
    broken = "head\n" + "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11)) + "\ntail of it"
    rows = [(1, broken, "q"), (2, "x\nReleased under the MIT License.\ny", "q"), (3, None, "q"), (4, "", "q"), (5, "all rights are reserved by nobody", "q"), (5, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", "q")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, dice string")).collect()
    assert [(r.doc_id, r.license, r.line) for r in sorted(got, key=lambda r: (r.doc_id, r.license or ""))] == [(1, "MIT", 1), (2, "MIT", 1), (3, None, None), (4, None, None), (5, None, None), (5, "CC-BY-NC-4.0", 1)]
    assert licenses.scan_licenses(empty).count() == 0


def test_license_bounds_lose_nothing():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, text in licenses.TEMPLATES:
        words = licenses.normal_words(text)
        kept = " ".join(w for k, w in enumerate(words) if k % 19 != 7)
        grams = lambda ws: Counter(zip(ws, ws[1:]))
        want = {n for n, t in licenses.TEMPLATES if licenses.dice(grams(kept.split()), grams(licenses.normal_words(t))) >= 0.8}
        assert {x[2] for x in scanner.scan(kept)} >= want, name


# 5


def test_quality_counts(docs):
    got = by_id(quality.text_measures(docs))
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.counts(t), k


def test_binomial_tail(spark):
    rows = [(20, 0), (300, 2), (500, 3), (4000, 30), (15, 0), (3000, 0)]
    got = spark.createDataFrame(rows, "n long, x long").select("n", "x", quality.binomial_tail(F.col("n"), F.col("x"), 0.0125).alias("p")).collect()
    for r in got:
        exact = sum(math.comb(r.n, i) * Fraction(1, 80) ** i * Fraction(79, 80) ** (r.n - i) for i in range(r.x + 1))
        assert abs(r.p - float(exact)) <= 1e-9 * float(exact)


def test_quality_controls_risk(spark):
    """Good texts are seldom rejected, texts far off always, and strata without proof keep all."""
    rows, labels = [], []
    for k in range(12000):
        noisy = k % 3 == 0
        rows.append((k, "few" if k % 400 == 1 else "en", 100, 500, 200 if noisy else k % 7, 10, 0, 0))
        labels.append((k, 0 if noisy else 1, 0))
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    cuts = {r.stratum: r for r in quality.risk_cutoffs(cut(spark.createDataFrame(rows, names)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert 6 / 500 <= cuts["en"].cut_symbol_share < 200 / 500 and cuts["few"].cut_symbol_share is None


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judge_quality(docs, labels))
    assert len(got) == len(TEXTS) and not got[0].kept and got[5].kept and got[0].base_failed
    assert quality.judge_quality(empty, labels).count() == 0 and quality.judge_quality(docs, labels.limit(0)).count() == len(TEXTS)


# 6


def test_mixing(spark, empty):
    rows = [(k, prose(20 + k % 30), "big" if k % 2 else f"s{k % 8}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    kept = cut(mixing.measured(df))
    total = kept.agg(F.sum("tokens")).first()[0]
    plan = mixing.plan_mixture(kept, entropy_share=0.97, epochs=3.0)
    drawn = mixing.mix_sources(df, entropy_share=0.97, epochs=3.0).cache()
    sums = {r.source: r for r in drawn.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("weight").alias("w"), F.max("epoch").alias("e")).collect()}
    assert abs(sum(r.w for r in sums.values()) - 1) < 1e-9 and 0 < plan.exponent < 1
    assert all(0 <= r.w * total - r.n <= 60 for r in sums.values())
    assert abs(-sum(r.w * math.log(r.w) for r in sums.values()) / math.log(len(sums)) - 0.97) < 1e-4 and all(r.e < 3 for r in sums.values())
    assert drawn.groupBy("doc_id", "epoch").count().filter("count > 1").isEmpty()
    assert mixing.mixed_documents(df, entropy_share=0.97, epochs=3.0).count() == drawn.count()


def _weights(sums, a):
    power = {s: (n / max(sums.values())) ** a for s, n in sums.items()}
    return {s: p / sum(power.values()) for s, p in power.items()}


@pytest.mark.parametrize("sizes, share, epochs, limited", [({"a": 300, "b": 200, "c": 200, "d": 90}, 0.6, 4.0, False), ({"a": 300, "b": 200, "c": 200, "d": 90}, 0.6, 1.5, True), ({"a": 100, "b": 99, "c": 98}, 0.9, 4.0, False)])
def test_mixing_sharpens(spark, sizes, share, epochs, limited):
    """A target below the sources' own entropy: exponents above 1, by another root search, up to the repetition limit."""
    rows = [(k, "w " * (1 + k % 3), s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = cut(mixing.measured(df))
    plan = mixing.plan_mixture(kept, entropy_share=share, epochs=epochs)
    sums = {r["__source"]: r.n for r in kept.groupBy("__source").agg(F.sum("tokens").alias("n")).collect()}
    entropy = lambda a: -sum(w * math.log(w) for w in _weights(sums, a).values() if w)
    passes = lambda a: max(w * sum(sums.values()) / sums[s] for s, w in _weights(sums, a).items())
    low, high = 1.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mid) <= share * math.log(len(sums)) or passes(mid) > epochs else (mid, high)
    assert abs(plan.exponent - low) < 1e-4 * low and plan.exponent > 1 and (passes(high) > epochs) == limited
    assert passes(plan.exponent) <= epochs + 1e-9
    drawn = mixing.mix_sources(df, entropy_share=share, epochs=epochs)
    got = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    for s, w in _weights(sums, plan.exponent).items():
        assert 0 <= w * sum(sums.values()) - got.get(s, 0) <= 6
    assert drawn.filter("epoch > 0").count() > 0


def test_mixing_of_equal_sources_stays(spark):
    df = spark.createDataFrame([(k, "a b", f"s{k % 4}") for k in range(80)] + [(99, "", "s1"), (98, None, "s2")], "doc_id long, text string, source string")
    assert mixing.plan_mixture(cut(mixing.measured(df))).exponent == 1.0 and mixing.mix_sources(df).count() == 82


def test_mixing_meets_the_repetition_limit(spark):
    rows = [(k, "a b c d", "big" if k % 20 else "rare") for k in range(2000)]
    drawn = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), entropy_share=1.0, epochs=2.0)
    assert drawn.filter("source = 'rare'").count() in (199, 200)  # the limit is met from below


def test_mixing_edges(docs, empty):
    got = mixing.mix_sources(docs, budget=None)
    assert {r.source for r in got.select("source").distinct().collect()} == {"", "s0", "s1", "s2"} and mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(docs.filter("doc_id < 3")).count() == 3


# 7


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken():
    enc, coder = reference(), bpe.Coder(open(RANKS, "rb").read(), bpe.char_classes().tobytes())
    alphabet = "abst'''  \n\t \u3000é9٣!#dmrevl漢😀\x1c\x85\u200b<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(4000)] + ["a" * 3000, " " * 999, "x" * 129, "'ll've", "\n\n", "a's 's ''s", LONG]
    for t, (ids, offsets) in zip(texts, coder.encode(texts)):
        assert ids.tolist() == enc.encode_ordinary(t), t
        assert coder.decode(ids, offsets) == t.encode()
        sizes = [len(enc.decode_single_token_bytes(i)) for i in ids.tolist()]
        assert offsets.tolist() == (np.cumsum([0, *sizes])[:-1]).tolist()


def test_bpe_classes_every_code_point_as_tiktoken():
    """Each code point beside letters, numbers, blanks, signs and apostrophes."""
    enc, coder = reference(), bpe.Coder(open(RANKS, "rb").read(), bpe.char_classes().tobytes())
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for make in (lambda c: f"a{c}b1{c}2 {c} {c}#{c}#\n", lambda c: f"{c}'s{c}'{c}ll {c}{c}\t{c}"):
        for at in range(0, len(points), 1 << 16):
            texts = ["".join(map(make, points[k : k + 64])) for k in range(at, min(len(points), at + (1 << 16)), 64)]
            for text, want, (ids, _) in zip(texts, enc.encode_ordinary_batch(texts), coder.encode(texts)):
                assert ids.tolist() == want, hex(ord(text[1]))


def test_bpe_scan_is_the_sequential_automaton():
    g = np.random.default_rng(3)
    symbols = g.integers(0, 9, 5000).astype(np.uint8)
    state, want = bpe.FRESH, []
    for s in symbols:
        want.append(bool(bpe.START[s, state]))
        state = bpe.STEP[s, state]
    for width in (1, 7, 256):
        assert bpe.token_starts(symbols, width).tolist() == want


def test_bpe_rows(docs, empty):
    enc, got = reference(), by_id(bpe.round_trip(docs, RANKS))
    for k, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(empty, RANKS).count() == 0
    coded = bpe.encode(docs.filter("doc_id = 4"), RANKS)
    assert coded.first().offsets[0] == 0 and bytes(bpe.decode(coded, RANKS).first().bytes) == b"Two words"


# 8


def test_url_parts(spark):
    rows = [("HTTP://A.Example.COM:80/En/7?q=/x#y", "a.example.com:80", "/En/7"), ("x://h#f/p", "h", ""), ("nohost/path", "", ""), (None, "", ""), ("a://", "", ""), ("a://B/c://d", "b", "/c://d")]
    got = spark.createDataFrame(rows, "url string, h string, p string").select("h", "p", F.coalesce(url_rules.url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(url_rules.url_path(F.col("url")), F.lit("")).alias("path")).collect()
    assert all((r.h, r.p) == (r.host, r.path) for r in got)


def test_url_rules(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/")]
    urls = ["http://www.example.com/en/71", "http://example.com/en/8", "http://notexample.com/en/7", "http://bad.org/x/1", "http://ok.org/x/1", None, "junk", "http://net/a", "http://m.net/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(k, f"http://{'bad' if k % 2 else 'ok'}.org/x/{k}", "h") for k in range(100, 300)] + [(None, "junk", "h")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(100, 300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, labels, rules).collect()}
    assert [got[k] for k in range(len(urls))] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), ("net/", "block")]
    assert url_rules.judge_urls(pages.limit(0), labels, rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, labels.limit(0), []).collect()} == {"allow"}


# 9


def test_mtree(spark):
    g = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in g.normal(size=8)] if i % 3 else [0.5] * 8) for i in range(700)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")]), (1004, []), (1005, [2.0]), (None, [1.0] * 8), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    known = [(i, np.pad(np.floor(64 * np.array(v, float)).astype(int), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for at, (q, x) in enumerate(known):
        if q % 20 == 0:
            best = sorted((-int(v @ x), i) for k, (i, v) in enumerate(known) if k != at)[:20]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    for shard in (90, 5000):
        assert Counter(map(tuple, mtree.top_by_inner_product(df, shard=shard, block=11).collect())) == want
    assert sorted(mtree.top_by_inner_product(df.filter("vec_id = 40")).select("vec_id").collect()) == [(40,), (40,)]  # each row finds the other
    assert mtree.top_by_inner_product(df.filter("vec_id = 60")).count() == 0 and mtree.top_by_inner_product(df.limit(0)).count() == 0


def test_mtree_of_huge_components(spark):
    g = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in g.normal(size=3) * 10.0 ** int(g.integers(0, 12))]) for i in range(60)] + [(100, [1e300, -1e300, 1.0])]
    known = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(64 * x))) for x in v]) for i, v in rows]
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = set()
    for q, x in known:
        if q % 20 == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(x, v))), i) for i, v in known if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in mtree.top_by_inner_product(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == want


def test_mtree_prunes_what_is_far():
    g = np.random.default_rng(4)
    centers = g.integers(-4000, 4000, (40, 6))
    v = (centers[:, None] + g.integers(-20, 20, (40, 200, 6))).reshape(-1, 6)
    tree = mtree.MTree(v, np.arange(len(v)), np.arange(len(v)), page=64)
    for i in range(0, len(v), 400):
        want = sorted(((-int(x), j) for j, x in enumerate(v @ v[i]) if j != i))[:5]
        assert tree.search(v[i], i, 5) == [(-s, j, j) for s, j in want]
        assert tree.search(v[i], i, 5, -want[2][0]) == [(-s, j, j) for s, j in want if s <= want[2][0]]
    assert tree.distances < 2 * len(v) * 20 / 2


# 10


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash(docs, empty, monkeypatch, bucket):
    prints = [(k, plain.simhash(t)) for k, t in enumerate(TEXTS)]
    want = plain.components(prints, 4)
    if bucket == 3:
        inner = simhash.link_fingerprints
        monkeypatch.setattr(simhash, "link_fingerprints", lambda fps, radius, parts: inner(fps, radius, parts, bucket))
    got = by_id(simhash.simhash_components(docs))
    assert all((got[k].fingerprint, got[k].component_id) == (f"{p:016x}", want[k]) for k, p in prints)
    assert simhash.simhash_components(empty).count() == 0
    assert {r.doc_id for r in simhash.one_per_group(docs).collect()} == set(want.values())


def test_simhash_links_are_complete(spark):
    g = np.random.default_rng(6)
    base = g.integers(0, 1 << 63, 60, np.uint64)
    prints = [int(b) for b in base] + [int(base[k % 60]) ^ sum(1 << int(x) for x in g.choice(64, int(g.integers(1, 7)), replace=False)) for k in range(300)]
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = components.connected_components(simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"))).collect()
    label = {r.node % (1 << 64): r.label for r in links}
    groups = plain.components([(p, p) for p in prints], 4)
    joined = lambda find: {frozenset(p for p in prints if find(p) == f) for f in {find(p) for p in prints}}
    assert joined(lambda p: label.get(p, p)) == joined(groups.get)
