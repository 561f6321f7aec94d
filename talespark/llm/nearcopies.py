"""Near copies by true similarity: MinHash bands fetch candidates, shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .components import connected_components
from .simhash import fingerprint

#: Bands of MinHash values and the values in each: a pair of similarity 0.8 shares no band about 3 times in a million.
BANDS, ROWS = 24, 4
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased in A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words; fewer words are one run, none are no run."""
    from xxhash import xxh64_intdigest

    whole = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[k : k + shingle])) for k in range(whole)), np.uint64, whole))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, its number in the upper bits."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 10):
        mixed = shingles[at : at + (1 << 10), None] * _FACTORS + _SHIFTS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0))
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(29)
    return (keys >> np.uint64(5)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(59))


def _digests(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, 1):
                digests, keys, sizes = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    digests.append(xxh3_128_digest(b" ".join(words)))
                    found = shingle_set(words, shingle)
                    sizes.append(len(found))
                    keys.append(bands(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "size", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [shingle_set(words_of(t), shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["digest", "shingles"])

    return run


def _spanning(least: float):
    """Links that join all that the similar pairs of a bucket join: a spanning forest, never all pairs."""

    def run(bucket: pa.Table) -> pa.Table:
        digests = bucket.column("digest").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in bucket.column("shingles").to_pylist()]
        label, sizes, edges = np.arange(len(sets)), np.array([len(s) for s in sets]), []
        for i in range(len(sets)):
            for j in np.flatnonzero(label[i + 1 :] != label[i]) + i + 1:
                if label[j] != label[i] and min(sizes[i], sizes[j]) >= least * max(sizes[i], sizes[j]) and similarity(sets[i], sets[j]) >= least:
                    label[label == label[j]] = label[i]
                    edges.append((digests[i], digests[j]))
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        for part in slices(batch, 1):
            digests = [xxh3_128_digest(b" ".join(words_of(t))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), part.column(1)], ["id", "digest", "text"])


def _links(plain: DataFrame, prints: DataFrame, nodes: DataFrame, shingle: int, least: float, bucket: int, most_shingles: int) -> DataFrame:
    """Links (a, b) of the digests of similar texts.

    Buckets with the same members are compared once; those of more than ``bucket`` members or ``most_shingles`` shingles
    are cut into blocks, and each pair of blocks is a bucket of its own, so no pair is lost. Texts are fetched only for
    digests that share a bucket, one text for each.
    """
    entries = prints.select("digest", "size", F.explode("keys").alias("key")).distinct()
    members = (F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    counted = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *members).filter("n > 1")
    wide = F.ceil(F.greatest(F.col("n") / bucket, F.col("total") / most_shingles)).cast("long")
    shared = cut(counted.groupBy("n", "x", "y").agg(F.min(F.struct("key", "total")).alias("one")).select("one.key", "n", F.col("one.total").alias("total")).select("key", F.least(wide, F.col("n")).alias("blocks")))
    own = F.pmod(F.xxhash64("digest", F.lit(2)), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least("own", j) * F.col("blocks") + F.greatest("own", j))
    met = cut(entries.join(shared, "key").withColumn("own", own).select("key", "digest", F.explode(pair).alias("pair")))
    asked = cut(nodes.join(met.select("digest").distinct(), "digest", "left_semi").select("digest", F.coalesce("rep", F.lit(0)).alias("rid")))
    texts = plain.mapInArrow(_texts, "id long, digest binary, text string").select("digest", F.coalesce("id", F.lit(0)).alias("rid"), "text")
    found = texts.join(asked, ["digest", "rid"], "left_semi").select("digest", "text").mapInArrow(_sets(shingle), "digest binary, shingles binary").distinct()
    return met.join(cut(found), "digest").groupBy("key", "pair").applyInArrow(_spanning(least), "a binary, b binary")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, bucket: int = 4096, most_shingles: int = 1 << 21) -> DataFrame:
    """(doc_id, component_id): groups of whole texts linked at a Jaccard similarity of ``least`` or more over their
    distinct ``shingle``-word runs; component_id is the least id reachable.

    Equal word sequences are one node, so copies cost one row; texts without words, or null, are one node too. Repeated
    rows and ids each get a row; a null id names no component unless all its group's ids are null. Other columns are not
    read. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(plain.mapInArrow(_digests(shingle), "id long, digest binary, size long, keys array<long>"))
    nodes = prints.groupBy("digest").agg(F.min("id").alias("rep"))
    links = connected_components(_links(plain, prints, nodes, shingle, least, bucket, most_shingles)).withColumnRenamed("node", "digest")
    # As in simhash_components(): only linked digests take part, and sides are written before they are joined.
    linked = cut(nodes.join(cut(links), "digest"))
    roots = cut(linked.groupBy("label").agg(F.min("rep").alias("root")))
    named = cut(linked.join(roots, "label").select("digest", "root"))
    found = cut(nodes.join(named, "digest", "left").select("digest", F.coalesce("root", "rep").alias("component_id")))
    return prints.select("id", "digest").join(found, "digest").select(F.col("id").alias("doc_id"), "component_id")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["digest", "fp"])


def fingerprint_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, bucket: int = 4096, most_shingles: int = 1 << 21) -> DataFrame:
    """The links of near_copies() as links (a, b) of the texts' SimHash fingerprints, for simhash_components()."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(plain.mapInArrow(_digests(shingle), "id long, digest binary, size long, keys array<long>"))
    nodes = prints.groupBy("digest").agg(F.min("id").alias("rep"))
    links = cut(_links(plain, prints, nodes, shingle, least, bucket, most_shingles))
    linked = links.select(F.col("a").alias("digest")).unionByName(links.select(F.col("b").alias("digest"))).distinct()
    asked = cut(nodes.join(linked, "digest", "left_semi").select("digest", F.coalesce("rep", F.lit(0)).alias("rid")))
    texts = plain.mapInArrow(_texts, "id long, digest binary, text string").select("digest", F.coalesce("id", F.lit(0)).alias("rid"), "text")
    fps = cut(texts.join(asked, ["digest", "rid"], "left_semi").select("digest", "text").mapInArrow(_fingerprints, "digest binary, fp long").distinct())
    ends = lambda c: fps.select(F.col("digest").alias(c), F.col("fp").alias(f"fp_{c}"))
    return links.join(ends("a"), "a").join(ends("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their group of near copies; the others go. All columns stay.

    Rows that repeat the kept id stay as they are, and so do rows whose id is null. Null and empty texts are one group. An
    empty table gives no rows. Columns may have any names.
    """
    groups = near_copies(docs, id_col, text_col, **options)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
