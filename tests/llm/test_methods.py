"""What the methods decide, against brute force: mined url rules, cutoffs and verdicts, draws of a mixture; odd rows and clashing names."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from talespark.llm import licenses, mixing, mtree, ordinal, quality, quotes, simhash, url_rules
from talespark.llm import queries as llm
from talespark.llm.common import cut

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, found = llm.QUERIES[name](spark, DATA), con.execute(llm.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


# 8


def items(url):
    rest = url.split("://", 1)[1].split("#")[0]
    place, _, query = rest.partition("?")
    host, _, path = place.partition("/")
    return frozenset([f"host {x}" for x in host.lower().split(".") if x] + [f"path {x}" for x in path.split("/") if x] + [f"query {x.split('=')[0]}" for x in query.split("&") if x.split("=")[0]])


@pytest.fixture(scope="module")
def crawl(spark):
    """Urls of which some combinations of items are mostly bad, and their labels."""
    draw = random.Random(11)
    pages, labels = [], []
    for k in range(1200):
        host, path, ask = draw.choice(["a.com", "b.com", "c.org", "news.c.org"]), draw.choice(["x", "y", "x/z", "ad/z"]), draw.choice(["", "?ref=1", "?ref=2&id=3", "?id=9"])
        url = f"http://{host}/{path}/{k}{ask}"
        bad = (host == "b.com" and "ref" in ask) or path.startswith("ad")
        pages.append((k, url, "h"))
        if k % 2:
            labels.append((k, int(bad == (draw.random() < 0.05)), 0))
    return pages, labels


def test_mined_rules_against_all_combinations(spark, crawl):
    pages, labels = crawl
    bad = {k: not q for k, q, _ in labels}
    baskets = [(items(u), bad[k]) for k, u, _ in pages if k in bad]
    n, n_bad = len(baskets), sum(b for _, b in baskets)
    seen, hits = Counter(), Counter()
    for found, b in baskets:
        for size in range(1, 5):
            for c in combinations(sorted(found), size):
                seen[c] += 1
                hits[c] += b
    least = max(0.005, 8 / n)
    rules = {c for c in seen if hits[c] >= least * n and hits[c] >= 0.8 * seen[c] and hits[c] / seen[c] >= 1.2 * n_bad / n}
    minimal = {c for c in rules if not any(set(d) < set(c) for d in rules)}
    schema = "page_id long, url string, html string"
    got = url_rules.mine_rules(spark.createDataFrame(pages, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r["items"]) for r in got.collect() if r["size"] <= 4} == minimal and any(len(c) > 1 for c in minimal)
    judged = url_rules.judge_urls(spark.createDataFrame(pages, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [])
    blocked = {r.page_id for r in judged.collect() if r.verdict == "block"}
    assert blocked == {k for k, u, _ in pages if any(set(c) <= items(u) for c in minimal)} and 0 < len(blocked) < len(pages)


def test_rules_match_alike_by_broadcast_and_by_shuffle(spark, crawl, monkeypatch):
    urls = spark.createDataFrame([(u,) for _, u, _ in crawl[0]] + [(None,), ("http://" + "a" * 100_000 + "/x/" + "y/" * 5000,)], "url string")
    rules = spark.createDataFrame([(1, ["host b", "query ref"]), (2, ["path ad"]), (3, ["host nowhere", "path x"]), (4, ["path y", "path x"])], "rule_id long, items array<string>")
    want = {r.url for r in url_rules.match_rules(urls, rules).collect()}
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    assert {r.url for r in url_rules.match_rules(urls, rules).collect()} == want
    assert want == {u for (u,) in urls.collect() if u and any(set(c) <= items(u) for c in (["host b", "query ref"], ["path ad"], ["path y", "path x"]))}
    assert url_rules.match_rules(urls, rules.limit(0)).count() == 0


# 5


def test_verdicts_against_exact_tests(spark):
    """Cutoffs and kept, from counts and labels, by exact fractions."""
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(9000):
        noisy = k % 4 == 0
        lang = "few" if k % 300 == 1 else "en" if k % 3 else "de"
        rows.append((k, lang, 200, 1000 + draw.randrange(200), draw.randrange(300, 500) if noisy else draw.randrange(12), 10, draw.randrange(5), draw.randrange(60)))
        labels.append((k, 0 if noisy else 1, 0))
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    counts = cut(spark.createDataFrame(rows, names))
    rated = spark.createDataFrame(labels + labels[:50], "doc_id long, quality int, toxic int")
    halves = {r.doc_id: r.half for r in counts.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).collect()}
    measure = {"symbol_share": lambda r: r[4] / r[3], "dup_line_share": lambda r: r[6] / r[5], "repeat_share": lambda r: r[7] / r[2], "word_length": lambda r: r[3] / r[2]}
    strata = {r[1] for r in rows if halves[r[0]] == 0}
    want = {}
    for s in strata:
        mine = [r for r in rows if r[1] == s and not 100 * r[7] > 50 * r[2]]
        good = [r for r in mine if halves[r[0]] == 1 and r[0] % 4]
        for rule, of in measure.items():
            seen, cutoffs = sorted(of(r) for r in mine if halves[r[0]] == 0), []
            for k in range(24):
                at = seen[max(0, math.ceil((1 - 0.75 ** (k + 1)) * len(seen) - 1e-9) - 1)]
                lost, risk = sum(of(r) > at for r in good), Fraction(1, 80)
                tail = sum(math.comb(len(good), i) * risk**i * (1 - risk) ** (len(good) - i) for i in range(lost + 1)) if lost < len(good) * risk else 1
                if tail <= Fraction(1, 20) / (4 * 24) / len(strata):
                    cutoffs.append(at)
            want[s, rule] = min(cutoffs, default=None)
    got = {r.stratum: r for r in quality.risk_cutoffs(counts, rated).collect()}
    assert {(s, rule): got[s][f"cut_{rule}"] for s in strata for rule in measure} == want
    assert any(v is not None for v in want.values()) and all(want["few", rule] is None for rule in measure)


def test_one_vote_for_each_id(spark):
    rows = [(k, "en", 100, 500, 1 if k % 2 else 200, 10, 0, 0) for k in range(4000)]
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4000)], "doc_id long, quality int, toxic int")
    once = quality.risk_cutoffs(cut(spark.createDataFrame(rows, names)), labels).collect()
    often = quality.risk_cutoffs(cut(spark.createDataFrame(rows + rows[:9] * 300, names)), labels).collect()
    assert once == often


# 6


def test_draws_against_a_plain_realisation(spark):
    draw = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(draw.randrange(1, 60))), draw.choice(["big"] * 8 + ["mid"] * 3 + ["small", None])) for k in range(3000)] + [(9000, None, "hollow"), (9001, "", "hollow"), (9002, None, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spots = mixing.measured(df).withColumn("__full", F.lit(0).cast("long"))
    known = [(r.id, r.__getitem__("__source"), r.tokens) for r in spots.collect()]
    total, sums = sum(t for _, _, t in known), Counter()
    for _, s, t in known:
        sums[s] += t
    share = {s: t / total for s, t in sums.items() if t}
    fits = lambda a: (lambda w: -sum(x * math.log(x) for x in w.values()) <= 0.95 * math.log(len(share)) + 1e-12 and max(w[s] * total / sums[s] for s in w) <= 4)({s: x**a / sum(y**a for y in share.values()) for s, x in share.items()})
    assert fits(1.0)  # else see test_mixing_sharpens
    low, high = 0.0, 1.0
    for _ in range(30):
        low, high = (low, (low + high) / 2) if fits((low + high) / 2) else ((low + high) / 2, high)
    z = sum(x**high for x in share.values())
    due = {s: x**high / z * total for s, x in share.items()}
    full = {s: int(due[s] / sums[s] + 1e-9) for s in due} | {"hollow": 1}
    placed = mixing.measured(df).withColumn("__full", F.create_map(*(F.lit(x) for kv in full.items() for x in kv))[F.col("__source")].cast("long")).withColumns(mixing._spots(7)).collect()
    want = Counter()
    for s in full:
        mine = [r for r in placed if r["__source"] == s]
        for r in mine:
            want[r.id] += full[s]
        room = due.get(s, 0) - full[s] * sums[s]
        for key in ("__block_place", "__part_place"):
            groups, taken = defaultdict(list), []
            for r in mine:
                groups[r[key]].append(r)
            for at in sorted(groups):
                size = sum(r.tokens for r in groups[at])
                if size > room:
                    mine = groups[at]  # the first that does not fit is cut into parts, then rows are left
                    break
                room -= size
                taken += groups[at]
            else:
                mine = []
            want.update(r.id for r in taken if due.get(s, 0) > full[s] * sums[s])
    got = Counter(r.doc_id for r in mixing.mix_sources(df).collect())
    assert got == +want


# Odd rows


def test_operators_with_clashing_names(spark):
    """Columns named as the operators name theirs do not change what they return."""
    names = "id fp key probe node label a b u v m rep root pair own blocks stratum words lines windows placed found n_words quality half __salt conv hash level size passage holder near far top parent items token needs n rule_id fit host hit verdict rank score row block shard query floor tree license dice line grade place".split()
    clash = lambda df: df.select("*", *(F.lit("x").alias(c) for c in names if c not in df.columns))
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate([None, "", "a b c", "released under the MIT License. " * 3, "x " * 200, "x " * 200])], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame([(1, 0, "u", "hello"), (1, 1, "a", "> hello\nyes"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "h"), (2, None, None), (None, "junk", "h"), (3, "http://x.org/es/" + "y" * 100_000, "h")], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(25)], "vec_id long, embedding array<double>")
    runs = [
        (docs, simhash.simhash_components), (docs, lambda d: quality.judge_quality(d, labels)), (docs, lambda d: ordinal.classify(d, ordinal.train(d, labels))), (docs, licenses.scan_licenses),
        (docs, mixing.mix_sources), (talks, quotes.format_conversations), (pages, lambda d: url_rules.judge_urls(d, labels, [("block", "org/es/")])), (vectors, mtree.top_by_inner_product),
    ]
    for df, run in runs:
        assert Counter(map(repr, run(clash(df)).collect())) == Counter(map(repr, run(df).collect())), run
        assert run(clash(df).limit(0)).count() == 0


def test_licences_in_very_long_texts(spark):
    long = "of the software and the of " * 30_000 + "released under the MIT license " + "word " * 30_000
    got = licenses.scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (got.license, got.dice) == ("MIT", 1.0)


def test_segments_follow_the_number_of_fingerprints():
    assert simhash.parts_for(1000) == 3 and simhash.parts_for(10**7) == 3 and simhash.parts_for(10**9) == 2 and simhash.parts_for(10**10) == 2
