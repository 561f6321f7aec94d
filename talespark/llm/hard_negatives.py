"""Hard negatives of anchors: windows of scores under each positive, their best rows found by distributed radix selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .mtree import HIGHEST, LOWEST, _matrix, whole_steps

#: Buckets of a histogram: one digit of a score or an id is 8 bits.
DIGIT = 8
#: Anchors whose scores with a batch of rows are held at a time.
CHUNK = 128


@dataclass
class Anchors:
    """A bounded group of anchors: their row numbers, ids, labels and vectors."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    chunks: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        for at in range(0, len(self.rows), CHUNK):
            whole = self.vectors[at : at + CHUNK]
            self.chunks.append((at, whole, whole.astype(np.float64)))


@dataclass
class Windows:
    """Score windows, one for each anchor and positive (a row of each array for an anchor, a column for a positive).

    top: the window's highest score. low..high: scores in which the last wanted row is known to lie; once that is one
    score, first..last are the ids in which it lies. above: rows of the window over that range. open: not yet narrow.
    """

    positive: np.ndarray
    top: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    above: np.ndarray
    by_id: np.ndarray
    open: np.ndarray

    def shift(self) -> np.ndarray:
        """Bits below the digit that splits each range in 2 ** DIGIT buckets at most."""
        width = np.where(self.by_id, self.last.astype(np.uint64) - self.first.astype(np.uint64), self.high.astype(np.uint64) - self.low.astype(np.uint64))
        return np.maximum(0, np.frexp(width.astype(np.float64))[1] - DIGIT).astype(np.uint64)

    def narrow(self, at: np.ndarray, bucket: np.ndarray, before: np.ndarray, rows: np.ndarray, enough: int) -> None:
        """Keep bucket ``bucket`` of the ranges at flat places ``at``, in which ``rows`` rows lie and ``before`` above it.

        Ranges not named hold fewer rows than wanted in all: they stay as they are and are gathered whole.
        """
        shift, flat = self.shift().ravel()[at], lambda a: a.reshape(-1)
        span = (np.uint64(1) << shift) - np.uint64(1)
        start = bucket.astype(np.uint64) << shift
        ids = flat(self.by_id)[at]
        high = np.where(ids, flat(self.high)[at], (flat(self.high)[at].astype(np.uint64) - start).astype(np.int64))
        room = high.astype(np.uint64) - flat(self.low)[at].astype(np.uint64)
        low = np.where(ids, flat(self.low)[at], (high.astype(np.uint64) - np.minimum(span, room)).astype(np.int64))
        first = np.where(ids, (flat(self.first)[at].astype(np.uint64) + start).astype(np.int64), flat(self.first)[at])
        left = flat(self.last)[at].astype(np.uint64) - first.astype(np.uint64)
        last = np.where(ids, (first.astype(np.uint64) + np.minimum(span, left)).astype(np.int64), flat(self.last)[at])
        above = flat(self.above)[at] + before
        flat(self.open)[:] = False
        for name, value in (("high", high), ("low", low), ("first", first), ("last", last), ("above", above)):
            flat(getattr(self, name))[at] = value
        flat(self.by_id)[at] = low == high
        flat(self.open)[at] = (above + rows > enough) & ((low < high) | (first < last))


def _scores(anchors: np.ndarray, floats: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows). A shorter vector is followed by zeros; products are kept within 64 bits."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = floats[:, :width], rows[:, :width].astype(np.float64)
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    if reach < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if reach < 1 << 62:
        return anchors[:, :width] @ rows[:, :width].T
    exact = anchors[:, :width].astype(object) @ rows[:, :width].astype(object).T
    return np.clip(exact, LOWEST + 1, HIGHEST).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first anchor, scores, row numbers, ids, same label) of each chunk of anchors with each slice of rows, these in the order of their ids."""
    for batch in batches:
        for part in slices(batch, 3):
            part = pa.Table.from_batches([part]).sort_by([("id", "ascending"), ("row", "ascending")])
            row, one, label = (part.column(c).to_numpy() for c in ("row", "id", "label"))
            vectors = _matrix(part)
            for at, whole, floats in anchors.chunks:
                yield at, _scores(whole, floats, vectors), row, one, anchors.labels[at : at + len(whole), None] == label


def _best_of_label(anchors: Anchors, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each anchor's k best other rows of its label among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for at, scores, row, one, alike in _met(batches, anchors):
            n = len(scores)
            held = best.get(at, np.zeros((4, 0), np.int64))
            scores = np.where(alike & (anchors.rows[at : at + n, None] != row), scores, LOWEST)
            floor = np.full(n, LOWEST + 1)
            counts = np.bincount(held[0], minlength=n)
            full = counts >= k  # ``held`` is in order, so a full anchor's last row is its k-th
            floor[full] = held[1][np.cumsum(counts)[full] - 1]
            if scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
            who, where = np.nonzero(scores >= floor[:, None])
            found = np.concatenate([held, np.stack([who, scores[who, where], one[where], row[where]])], axis=1)
            found = found[:, np.lexsort((found[3], found[2], -found[1], found[0]))]
            starts = np.searchsorted(found[0], np.arange(n))
            best[at] = found[:, np.arange(found.shape[1]) - starts[found[0]] < k]
        for at, (who, score, one, row) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(who + at), pa.array(score), pa.array(one), pa.array(row)], ["anchor", "score", "id", "row"])

    return run


def _in_windows(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, of: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(positive's place, anchors, scores, ids) of rows of other labels with scores from low to ``reach`` in the windows marked by ``of``."""
    least = np.where(of, windows.low, HIGHEST).min(axis=1)
    most = np.where(of, reach, LOWEST).max(axis=1)
    for at, scores, _, one, alike in _met(batches, anchors):
        n = len(scores)
        who, where = np.nonzero(~alike & (scores >= least[at : at + n, None]) & (scores <= most[at : at + n, None]))
        score, one, who = scores[who, where], one[where], who + at
        for j in range(of.shape[1]):
            inside = of[who, j] & (score >= windows.low[who, j]) & (score <= reach[who, j])
            yield j, who[inside], score[inside], one[inside]


def _histogram(anchors: Anchors, windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(window, bucket, n): how many rows fall in each bucket of each open window's range; bucket 0 comes first in the order."""
    wide, shift = windows.open.shape[1], windows.shift()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j, who, score, one in _in_windows(batches, anchors, windows, windows.open, windows.high):
            ids = windows.by_id[who, j]
            fit = ~ids | ((one >= windows.first[who, j]) & (one <= windows.last[who, j]))
            past = np.where(ids, one.astype(np.uint64) - windows.first[who, j].astype(np.uint64), windows.high[who, j].astype(np.uint64) - score.astype(np.uint64))
            bucket = (past >> shift[who, j]).astype(np.int64)
            cell, n = np.unique((((who * wide + j) << DIGIT) + bucket)[fit], return_counts=True)
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(cell >> DIGIT), pa.array((cell & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["window", "bucket", "n"])

    return run


def _gather(anchors: Anchors, windows: Windows, positive_ids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that qualify, alike ones counted: those of a window down to where its last wanted row lies."""
    wide, every = windows.open.shape[1], windows.positive >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j, who, score, one in _in_windows(batches, anchors, windows, every, windows.top):
            fit = ~windows.by_id[who, j] | (score > windows.low[who, j]) | (one <= windows.last[who, j])
            who, score, one = who[fit], score[fit], one[fit]
            if not len(who):
                continue
            found, n = np.unique(np.stack([who, score, one]), axis=1, return_counts=True)
            who = found[0]
            cols = [who * wide + j, anchors.ids[who], positive_ids[who, j], windows.top[who, j], found[1], found[2], n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["window", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id", "n"])

    return run


def _first(found: DataFrame, by: str, order: str, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr(f"row_number() over (partition by {by} order by {order})")).filter(F.col("rank") <= k)


def _windows(anchors: Anchors, positives: pa.Table, k: int, least_percent: int, ids: tuple[int, int]) -> tuple[Windows, np.ndarray]:
    """The windows under the positives found, and the ids of these."""
    shape = (len(anchors.rows), k)
    who, place = positives.column("anchor").to_numpy(), positives.column("rank").to_numpy() - 1
    full = lambda v, kind=np.int64: np.full(shape, v, kind)
    score, positive, positive_id = full(-1), full(-1), full(0)
    score[who, place], positive[who, place], positive_id[who, place] = (positives.column(c).to_numpy() for c in ("score", "row", "id"))
    positive[score < 0] = -1  # a window under a negative score is empty: its lower end lies above its upper one
    whole, rest = np.divmod(np.maximum(score, 0), 100)
    low = whole * least_percent - (-rest * least_percent) // 100
    return Windows(positive, score, low, score.copy(), full(ids[0]), full(ids[1]), full(0), low == score, positive >= 0), positive_id


def mine_hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5, least_percent: int = 80, scale: int = 256, group_bytes: int = 32 << 20, enough: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Anchors are rows whose id is divisible by ``every``; an anchor's positives are its first ``positives`` other rows of the
    same label, by score, then id. Hard negatives are the first ``k`` rows of other labels whose score lies between
    ``least_percent`` % of the positive's and the positive's own.

    Anchors go in groups whose vectors take about ``group_bytes``; a group is broadcast and the vectors stay where they
    are, so none is shuffled. For each group: a pass in which each task keeps the best rows of an anchor's label; passes
    that count scores of other labels by one digit for each window, add these histograms up and keep the bucket of the
    k-th row, digit by digit, ids following scores where one score is that of many; and a pass that gathers the rows down
    to there, at most ``enough`` different ones for a window. Only a row for each window comes to the driver.

    Rows with a null id or label, a null vector or null or non-finite components take no part. Rows that repeat an id, or
    are alike in full, are rows of their own: as anchors, positives and negatives. A vector shorter than others is
    followed by zeros. Fewer positives or negatives than wanted: all of them. Components and scores are kept within 64
    bits. Other columns, of any names, are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = F.col(label) if isinstance(label, str) else label
    known = vectors.select(F.col(id_col).cast("long").alias("id"), kind.cast("long").alias("label"), whole_steps(F.col(vector_col), scale).alias("v"))
    known = cut(known.filter("id is not null and label is not null and v is not null").select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"))
    is_anchor = F.pmod("id", F.lit(every)) == 0
    n, width, low, high = known.agg(F.count_if(is_anchor), F.max(F.size("v")), F.min("id"), F.max("id")).first()
    groups = -(-n * max(1, width or 0) * 8 // group_bytes)
    out = []
    for g in range(groups):
        mine = known.filter(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(groups)) == g)).toArrow()
        anchors = Anchors(*(mine.column(c).to_numpy() for c in ("row", "id", "label")), _matrix(mine))
        if not len(anchors.rows):
            continue
        best = known.mapInArrow(_best_of_label(anchors, positives), "anchor long, score long, id long, row long")
        found = _first(best, "anchor", "score desc, id, row", positives).toArrow()
        windows, positive_ids = _windows(anchors, found, positives, least_percent, (low, high))
        while windows.open.any():
            counts = known.mapInArrow(_histogram(anchors, windows), "window long, bucket int, n long").groupBy("window", "bucket").agg(F.sum("n").alias("n"))
            upto = counts.withColumn("upto", F.expr("sum(n) over (partition by window order by bucket)"))
            above = spark.createDataFrame(pa.table({"window": np.flatnonzero(windows.open), "above": windows.above[windows.open]}))
            reached = upto.join(F.broadcast(above), "window").filter(F.col("upto") + F.col("above") >= k)  # a row for each open window
            at = reached.groupBy("window").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n")).alias("at")).select("window", "at.*").toArrow()
            windows.narrow(*(at.column(c).to_numpy() for c in ("window", "bucket", "before", "n")), enough)
        kept = known.mapInArrow(_gather(anchors, windows, positive_ids), "window long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long, n long")
        names = ["window", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"]
        kept = kept.groupBy(*names).agg(F.sum("n").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k).cast("long")))))
        out.append(cut(_first(kept, "window", "negative_score desc, negative_id, copy", k)))
    if not out:
        out = [spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")]
    return reduce(DataFrame.unionByName, out).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
