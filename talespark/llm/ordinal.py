"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices

#: Characters taken off both ends of a word before it is hashed; their kind is a feature of its own.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct feature hashes of a whole text: bare words, signs at words' edges, capitals and
    words that echo the one before, each by share."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    mask, bare, signs, capitals, edged = (1 << bits) - 1, set(), {}, 0, 0
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    for w, n in distinct.items():
        core = w.strip(EDGES)
        if core:
            bare.add(core.lower())
            if len(core) > 1 and core.isupper():
                capitals += n
        if len(core) < len(w) and (rest := w.replace(core, "", 1) if core else w) not in ".,":
            signs[rest] = signs.get(rest, 0) + n
            edged += n

    def share(k: int) -> int:
        return int(np.ceil(10 * k / len(words)))

    out = {crc32(b"w " + w.encode("utf-8", "replace")) & mask for w in bare}
    out |= {crc32(f"s {s} {share(n)}".encode("utf-8", "replace")) & mask for s, n in signs.items() if share(n) > 0}
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    out |= {crc32(f"{kind} {k}".encode()) & mask for kind, n in (("capitals", capitals), ("edged", edged), ("echoes", echoes)) for k in range(1, share(n) + 1)}
    return np.array(sorted(out), np.int64)


@dataclass
class OrdinalModel:
    """P(grade > k) = 1 / (1 + exp(thresholds[k] - w.x)), one weight vector for all k, thresholds in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, text: str | None) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[features(text, self.bits)].sum(), -30, 30)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, bits: int, top: int = 2, least_docs: int = 8, l1: float = 1e-3, rounds: int = 300, step: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with a lasso on the weights, by full-batch Adam with proximal steps over the cumulative logits.

    Grades are 0 to ``top``, whether or not examples of each are there: a threshold with no example above it is
    infinite, so nothing is given a grade that nobody gave, and one with none below it is infinitely low.

    Features found in fewer than ``least_docs`` rows keep weight 0. Thresholds are a first one plus exponentials, so they
    stay in order. The lasso leaves most of the many rare words at 0, so long texts do not gather noise. Without rows, or with one grade only, all weights
    are 0 and tails follow the thresholds alone.
    """
    weights = np.zeros(1 << bits)
    if not len(rows) or len(np.unique(grades)) < 2:
        lean = np.where(np.arange(top) < (grades[0] if len(grades) else top), -4.0, 4.0)
        return OrdinalModel(weights, lean, bits)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    kept, place, seen = np.unique(flat, return_inverse=True, return_counts=True)
    use = seen >= least_docs
    owner = np.repeat(np.arange(len(rows)), sizes)[use[place]]
    column = (np.cumsum(use) - 1)[place[use[place]]]
    beta, gaps = np.zeros(int(use.sum())), np.r_[-1.0, np.zeros(top - 1)]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (beta, gaps)]
    above = grades[:, None] > np.arange(top)
    for t in range(1, rounds + 1):
        cuts = gaps[0] + np.r_[0, np.cumsum(np.exp(gaps[1:]))]
        score = np.bincount(owner, beta[column], len(rows))
        up = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -30, 30)))
        edges = np.c_[np.ones(len(rows)), up, np.zeros(len(rows))]
        slope = edges * (1 - edges)
        at = np.arange(len(rows))
        p = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        d_score = (slope[at, grades] - slope[at, grades + 1]) / p / len(rows)
        d_cut = np.zeros((len(rows), top + 2))
        d_cut[at, grades] -= slope[at, grades] / p / len(rows)
        d_cut[at, grades + 1] += slope[at, grades + 1] / p / len(rows)
        d_cuts = d_cut.sum(0)[1:-1]
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grads = (-np.bincount(column, d_score[owner], len(beta)), -np.r_[tail[0], tail[1:] * np.exp(gaps[1:])])
        for x, g, (m, v) in zip((beta, gaps), grads, state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            scale = step / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
            x -= scale * m / (1 - 0.9**t)
            if x is beta:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - scale * l1, 0)
    weights[kept[use]] = beta
    cuts = gaps[0] + np.r_[0, np.cumsum(np.exp(gaps[1:]))]
    cuts[np.arange(top) >= grades.max()], cuts[np.arange(top) < grades.min()] = np.inf, -np.inf
    return OrdinalModel(weights, cuts, bits)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a table of labels: 0 toxic, 1 of low quality, 2 good; the lowest of a document's ratings counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("__id"), grade.alias("grade")).filter("__id is not null and grade is not null").groupBy("__id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, bound: int = 12000, most_features: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``bound`` labelled documents, those with the least hash of their id, as far as they hold
    ``most_features`` feature hashes together; only these hashes (64 MB at most) reach the driver.

    Of rows that repeat a chosen id, the text with the least hash stands for the id, so a hot id is one example as any
    other. Ids or ratings that are null are no examples; null and empty texts are examples without features. Without
    examples, or with one grade only, the model has thresholds alone; a grade without examples is given to none (fit_ordinal). Other columns are not read.
    """
    chosen = graded(labels).withColumn("__place", F.xxhash64("__id")).orderBy("__place", "__id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "__id")  # at most ``bound`` rows of three numbers
    sample = met.groupBy("__place", "__id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("__place", "__id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                found = [features(t, bits).astype(np.int32) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["place", "id", "grade", "n", "found"])

    seen = cut(sample.mapInArrow(run, "place long, id long, grade int, n long, found binary"))
    so_far = F.sum("n").over(W.orderBy("place", "id"))  # over ``bound`` rows at most
    fits = seen.select("place", "id", "n").withColumn("so_far", so_far).filter(F.col("so_far") <= most_features).select("place", "id")
    got = seen.join(F.broadcast(fits), ["place", "id"]).orderBy("place", "id").select("grade", "found").collect()
    return fit_ordinal([np.frombuffer(r.found, np.int32).astype(np.int64) for r in got], np.array([r.grade for r in got], np.int64), bits)


def classify(docs: DataFrame, model: OrdinalModel, least: int = 2, tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail, kept) of each row: kept if P(grade >= least) is ``tail`` or more.

    Whole texts are scored. A text without words, or null, has no evidence against it: the thresholds alone decide.
    Repeated rows are scored alike; a null id stays null; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2 ** bits numbers, whatever the data
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value, bits)
        for batch in batches:
            for part in slices(batch, 1):
                tails = np.array([own.tails(t) for t in part.column(1).to_pylist()]).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1)), pa.array(tails[:, least - 1])], ["doc_id", "expected_grade", "tail"])

    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail double")
    return scored.withColumn("kept", F.col("tail") >= tail)


def keep_good(docs: DataFrame, model: OrdinalModel, least: int = 2, tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with all their columns, in one pass without a shuffle.

    Nulls, empty texts, repeated rows and empty tables are treated as there; columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    bits, at = model.bits, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value, bits)
        for batch in batches:
            for part in slices(batch, at):
                tails = np.array([own.tails(t) for t in part.column(at).to_pylist()]).reshape(len(part), -1)
                yield part.filter(pa.array(tails[:, least - 1] >= tail))

    return docs.mapInArrow(run, docs.schema)
