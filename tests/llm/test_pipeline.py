"""Each stage of the pipeline on its own input, against a plain version."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline

from . import plain

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input of each stage and the last one's output."""
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns(stages):
    assert stages[1][:5] == [COLUMNS] * 5


def test_quality_keeps_good_labelled_documents(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1]}
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_near_duplicates(stages):
    """Against the true similarity of all pairs over five-word shingles, 0.8 or more."""
    sets = {r.doc_id: plain.shingles(r.text) for r in stages[0][1]}
    assert {r.doc_id for r in stages[0][2]} == set(plain.groups(sets, 0.8).values())


def test_repeated_spans(stages):
    rows = sorted(stages[0][2], key=lambda r: r.doc_id)
    raw = [r.text.encode() for r in rows]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = {}
    for r, b in zip(rows, raw):
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        starts = [m.start() for m in re.finditer(rb"[^\x80-\xbf]", b)] + [len(b)]
        want[r.doc_id] = b"".join(b[s:e] for s, e in zip(starts, starts[1:]) if not all(mark[s:e])).decode()
    assert {r.doc_id: r.text for r in stages[0][3]} == want and all(r.n_chars == len(r.text) for r in stages[0][3])


def test_mixture_draws_what_was_there(stages):
    before = {r.doc_id: r for r in stages[0][3]}
    assert stages[0][4] and all(r == before[r.doc_id] for r in stages[0][4])


def test_tokens(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in stages[0][4]:
        ids = enc.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in stages[0][5]) == want


def test_run_equals_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, stages[0][5]))


CLASHES = "k1 k2 spans text_ left right word bits row end end_part weight room epoch __full __block __source __key __word __k1 __row tokens h c own low high digest rep label fp key component_id gone __gone grade tail kept".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows, and names that the stages use within."""
    shared = " ".join(f"shared{k % 37}x{k}" for k in range(60))
    texts = [None, "", " \n", "one", shared, "head words here " + shared, shared + " and a tail", "long " * 40000 + shared, "é" * 500, "twice told", "twice told"]
    rows = [(k, t, "en", "s" if k % 2 else None, len(t or "")) for k, t in enumerate(texts)] + [(4, shared, None, "s", None), (None, "no id at all", "en", "s", 12), (None, None, None, None, None)]
    rows += [(100 + k, " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(80)), "en", f"s{k % 3}", 1) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(100 + k, 1 - k % 2, None if k % 5 else 0) for k in range(10)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return df, folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, odd, name):
    """What a stage does with odd rows, with and without clashing columns, and with an empty table."""
    docs, folder = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
    got = stage(spark, docs, folder).collect()
    clashing = stage(spark, wide, folder)
    plainly = clashing.collect()
    assert stage(spark, wide.limit(0), folder).count() == 0
    names = COLUMNS if name != "tokens" else clashing.columns
    assert Counter(tuple(r[c] for c in names) for r in plainly) == Counter(tuple(r[c] for c in names) for r in got)
    if name != "tokens":
        assert clashing.columns == wide.columns and all(r[c] == k for r in plainly for k, c in enumerate(CLASHES))
    rows = docs.collect()
    if name == "near_duplicates":
        ids = Counter(r.doc_id for r in got)
        assert ids[0] == 1 and not ids[1] and not ids[2] and ids[9] == 1 and not ids[10] and ids[4] == 2 and ids[None] == 2
    elif name == "repeated_spans":
        texts = {r.doc_id: r.text for r in got if r.doc_id is not None}
        assert len(got) == len(rows) and texts[0] is None and texts[1] == "" and texts[4] == "" and texts[9] == "twice told" and texts[5].startswith("head words") and texts[8] == ""
    elif name == "mixture":
        assert {r.doc_id for r in got} <= {r.doc_id for r in rows} and set(got) <= set(rows)
    elif name == "tokens":
        assert len(got) == len(rows) and sum(r.n_tokens == 0 for r in got) == 3 and sum(r.doc_id is None for r in got) == 2
    else:
        assert set(got) <= set(rows)


def test_stages_leave_no_files(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        corpus_pipeline.run(spark, DATA).count()
        left = [p.name for p in tmp_path.rglob("pipeline-*/*")]
        assert left == ["3-mixture"] and not list(tmp_path.rglob("scratch-*"))
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])
