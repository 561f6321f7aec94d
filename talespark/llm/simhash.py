"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text; 0 for a text without words."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, whole = b" ".join(words), max(1, n - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:whole].tolist()
    ends = ends[min(n, shingle) - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, whole, 1 << 14):
        raw = b"".join([xxh64_digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > whole).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long; one row per input row, null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.array([fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, fp long")


def _segments(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, from the low bits up; the first ones are the wider."""
    width, more = divmod(BITS, parts)
    out, at = [], 0
    for k in range(parts):
        out.append((at, width + (k < more)))
        at += out[-1][1]
    return out


def _entries(radius: int, parts: int) -> Callable:
    """Table entries and probes of each fingerprint.

    With r' = radius div parts and a = radius - parts * r', two fingerprints within the radius differ by r' or
    less in one of the first a + 1 segments, or by r' - 1 or less in one of the others. Each fingerprint is put in
    the table of each segment, and probes the segment's ball. Of a pair, just the one with 0 in the lowest differing
    bit probes, so each pair meets once in a segment.
    """
    small, more = divmod(radius, parts)
    plan = []
    for k, (shift, width) in enumerate(_segments(parts)):
        ball = small if k <= more else small - 1
        if ball < 0:
            continue
        masks = [sum(1 << b for b in bits) for n in range(1, ball + 1) for bits in combinations(range(width), n)]
        plan.append((k, shift, width, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                signed = batch.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False)
                fps = signed.view(np.uint64)
                keys, own, probe = [], [], []
                for k, shift, width, masks in plan:
                    value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    tag = np.uint64(k << 56)
                    keys.append(value | tag)
                    own.append(signed)
                    probe.append(np.zeros(len(fps), bool))
                    for mask in masks:
                        ask = (value & np.uint64(mask & -mask)) == 0
                        keys.append((value[ask] ^ np.uint64(mask)) | tag)
                        own.append(signed[ask])
                        probe.append(np.ones(len(own[-1]), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own)), pa.array(np.concatenate(probe))], ["key", "fp", "probe"])

    return run


def _spanning(fps: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within one bucket that join all that its verified pairs join: a spanning forest, never all pairs."""
    order = np.argsort(probe, kind="stable")
    fps, n_table = fps[order], int((~probe).sum())
    label, edges = np.arange(len(fps)), []
    for i in range(n_table):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1  # pairs that are joined already need no more links
        near = other[np.bitwise_count(fps[other] ^ fps[i]) <= radius]
        for j in near:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((i, j))
    return [(int(fps[i]), int(fps[j])) for i, j in edges]


def _links(radius: int) -> Callable:
    """Verified links of buckets that arrive sorted by (key, block); a bucket is held whole, and is bounded by the split."""

    def bucket(fps: np.ndarray, probe: np.ndarray, out: list) -> None:
        if len(fps) > 1 and not probe.all():
            out += _spanning(fps, probe, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_fp, held_probe = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            probe = batch.column(3).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            ends = np.r_[heads[1:], len(fps)]
            out: list = []
            first = tuple(keys[:, 0]) if len(fps) else key
            if key is not None and first != key:
                bucket(np.concatenate(held_fp), np.concatenate(held_probe), out)
                held_fp, held_probe = [], []
            big = np.flatnonzero(ends - heads > 1)
            for h, e in zip(heads[big], ends[big]):
                if h and e < len(fps):
                    bucket(fps[h:e], probe[h:e], out)
            if len(heads) > 1:  # the first one may go on from the last batch, the last one into the next
                held_fp.append(fps[: ends[0]])
                held_probe.append(probe[: ends[0]])
                bucket(np.concatenate(held_fp), np.concatenate(held_probe), out)
                held_fp, held_probe = [], []
            if len(heads):
                held_fp.append(fps[heads[-1] :])
                held_probe.append(probe[heads[-1] :])
                key = tuple(keys[:, -1])
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if held_fp:
            out = []
            bucket(np.concatenate(held_fp), np.concatenate(held_probe), out)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def parts_for(count: int, radius: int = 4, most: int = 256) -> int:
    """Segments for ``count`` fingerprints: the most, up to three, whose tables fetch about ``most`` rows a fingerprint by chance.

    Fewer segments are wider: they need larger balls, so more probes, but meet far fewer strangers.
    """
    for parts in (3, 2):
        small, more = divmod(radius, parts)
        met = 0.0
        for k, (_, width) in enumerate(_segments(parts)):
            ball = small if k <= more else small - 1
            met += count * sum(comb(width, n) for n in range(ball + 1)) / 2.0**width
        if met <= most:
            return parts
    return 2


def link_fingerprints(fps: DataFrame, radius: int = 4, parts: int = 3, bucket: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that join all within ``radius`` of each other.

    Buckets of more than ``bucket`` rows are cut into blocks; each pair of blocks is a bucket of its own, so no task
    holds more than two blocks and no pair is lost.
    """
    entries = fps.select("fp").mapInArrow(_entries(radius, parts), "key long, fp long, probe boolean")
    hot = cut(entries.groupBy("key").count().filter(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).alias("blocks")))
    if hot.isEmpty():
        dealt = entries.select("key", F.lit(0).cast("long").alias("pair"), "fp", "probe")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least("own", j) * F.col("blocks") + F.greatest("own", j))
        met = entries.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        dealt = met.select("key", F.explode(pair).alias("pair"), "fp", "probe")
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, parts: int | None = None, seed: int = 42, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups of whole texts.

    Texts are lower-cased in A-Z, cut into words, and hashed as ``shingle``-word runs, repeats included (fewer words:
    the whole sequence; none: fingerprint zero). Equal fingerprints are one node, so copies cost one row; different
    ones are linked at ``radius`` or fewer differing bits. component_id is the least id reachable. ``parts`` (by default
    parts_for() the number of distinct fingerprints) sets the cost, never the result. ``more``: a function of ``docs`` whose
    links (a, b), of fingerprints, join what differs by more bits.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and repeated ids each get a
    row; a null id gets a row and names no component unless all its group's ids are null, which leaves it null. Other
    columns are not read. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    links = link_fingerprints(nodes, radius, parts or parts_for(nodes.count(), radius))
    if more:
        links = cut(links).unionByName(more(docs))
    links = cut(connected_components(links).withColumnRenamed("node", "fp"))
    # Only linked fingerprints take part in this join, and its sides are written before, so that a large component can be split.
    linked = cut(nodes.join(links, "fp"))
    roots = cut(linked.groupBy("label").agg(F.min("rep").alias("root")))
    named = cut(linked.join(roots, "label").select("fp", "root"))
    found = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    return prints.join(found, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their near-duplicate group; the others go. All columns stay.

    Rows that repeat the kept id stay as they are, and so do rows whose id is null. Null and empty texts are one group. An
    empty table gives no rows. Columns may have any names.
    """
    groups = simhash_components(docs, id_col, text_col, **options)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
