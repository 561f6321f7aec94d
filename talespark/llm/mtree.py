"""Exact top-k by inner product: best-first search in M-trees over shards of the vectors."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

#: From this squared norm on, products are whole numbers of Python, as 64 bits might not hold them.
BIG = 1 << 61
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class Page:
    """A node: a routing object's page of entries, each with its distance to that object.

    An inner page's entries are pages with covering radii; a leaf's entries are rows of the data. ``rows`` are places in
    the tree's arrays: routing objects of an inner page, members of a leaf.
    """

    __slots__ = ("rows", "to_parent", "radii", "children")

    def __init__(self, rows: np.ndarray, to_parent: np.ndarray, radii: np.ndarray | None = None, children: list[Page] | None = None):
        self.rows, self.to_parent, self.radii, self.children = rows, to_parent, radii, children


class MTree:
    """M-tree over integer vectors under the Euclidean metric of a lifted space.

    Each vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm; a query gets 0 there. Then
    |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest rows are those of the largest inner product, and the triangle
    inequality holds for pruning.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, page: int = 512, fan: int = 16):
        self.vectors, self.ids, self.own = vectors, ids, rows
        self._measure()
        every = np.arange(len(ids))
        self.root = self._build(every, np.zeros(len(ids)), page, fan)

    def _measure(self) -> None:
        self.distances = 0
        self.flat = self.vectors.astype(np.float64)
        top = float((self.flat * self.flat).sum(1).max(initial=0))
        whole = self.vectors.astype(object) if top >= BIG else self.vectors.astype(np.int64)
        norms = (whole * whole).sum(1)
        self.most = int(norms.max()) if len(norms) else 0
        self.lift = np.sqrt((self.most - norms).astype(np.float64))
        self.exact = self.most < 1 << 50  # then float products of two rows are exact integers

    def __getstate__(self) -> tuple:
        """What a stored tree is: vectors in as few bytes as hold them, ids, and pages. The rest is computed from these."""
        top = int(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
        return self.vectors.astype(kind), self.ids, self.own, self.root

    def __setstate__(self, state: tuple) -> None:
        vectors, self.ids, self.own, self.root = state
        self.vectors = vectors.astype(np.int64)
        self._measure()

    def _products(self, rows: np.ndarray, query: np.ndarray, base: int) -> np.ndarray:
        """Inner products of rows with a query, exact, kept within 64 bits."""
        if self.exact and base < 1 << 51:
            return (self.flat[rows] @ query.astype(np.float64)).astype(np.int64)
        if base < BIG:
            return self.vectors[rows] @ query
        return np.clip(self.vectors[rows].astype(object) @ query.astype(object), LOWEST, HIGHEST)

    def _from(self, at: int, rows: np.ndarray) -> np.ndarray:
        d = ((self.flat[rows] - self.flat[at]) ** 2).sum(1) + (self.lift[rows] - self.lift[at]) ** 2
        return np.sqrt(d)

    def _build(self, rows: np.ndarray, to_parent: np.ndarray, page: int, fan: int) -> Page:
        if len(rows) <= page:
            return Page(rows, to_parent)
        near = np.full(len(rows), np.inf)
        owner = np.zeros(len(rows), np.int64)
        pivots, at = [], 0
        for k in range(min(fan, -(-len(rows) // page) + 1)):  # each next pivot is the row farthest from those before
            d = self._from(rows[at], rows)
            closer = d < near
            owner[closer], near[closer] = k, d[closer]
            pivots.append(at)
            at = int(near.argmax())
            if near[at] == 0:
                break
        if len(pivots) == 1:  # all alike: halves around one routing object
            owner = np.arange(len(rows)) % 2
            pivots = [0, 1]
        parts = [np.flatnonzero(owner == k) for k in range(len(pivots))]
        held = [(rows[p], part) for p, part in zip(pivots, parts) if len(part)]
        radii = np.array([near[part].max() for _, part in held])
        up = np.array([to_parent[p] for p, part in zip(pivots, parts) if len(part)])
        return Page(np.array([r for r, _ in held]), up, radii, [self._build(rows[part], near[part], page, fan) for _, part in held])

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, id, row), ties to the smaller id, without the row ``own``; none below ``floor``, if given."""
        dims = self.vectors.shape[1]
        base = sum(x * x for x in query.tolist()) + self.most
        query = np.pad(query[:dims], (0, max(0, dims - len(query))))
        q = query.astype(np.float64)
        # Distances come from rounded square roots; this is more than they can be off by.
        slack = 1e-6 + float(np.sqrt(float(base) * (dims + 8))) * 2.0**-24
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row)
        bounds = lambda score: np.inf if score is None or score == LOWEST else np.sqrt(float(max(0, base - 2 * score)))
        limit = bounds(floor)
        queue: list = [(0.0, 0, None, self.root)]
        order = 0
        while queue:
            bound, _, up, page = heapq.heappop(queue)
            if bound > limit + slack:
                break
            rows = page.rows
            if up is not None:  # |d(q, parent) - d(row, parent)| bounds d(q, row) from below without computing it
                spare = np.abs(up - page.to_parent) - (0 if page.radii is None else page.radii) <= limit + slack
                rows = rows[spare]
            if not len(rows):
                continue
            self.distances += len(rows)
            if page.radii is None:
                scores = self._products(rows, query, base)
                least = best[0][0] if len(best) == k else np.sort(scores)[-k - 1] if len(scores) > k + 1 else scores.min()
                if floor is not None:
                    least = max(least, floor)
                good = np.flatnonzero(scores >= least)
                for score, vec, row in zip(scores[good].tolist(), self.ids[rows[good]].tolist(), self.own[rows[good]].tolist()):
                    if row == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec, -row))
                    elif (score, -vec, -row) > best[0]:
                        heapq.heapreplace(best, (score, -vec, -row))
                if len(best) == k:
                    limit = min(limit, bounds(best[0][0]))
            else:
                d = np.sqrt(np.maximum(0, float(base) - 2 * (self.flat[rows] @ q)))
                kept = page.children if up is None else [c for c, s in zip(page.children, spare) if s]
                radii = page.radii if up is None else page.radii[spare]
                for low, dist, child in zip(np.maximum(0, d - radii).tolist(), d.tolist(), kept):
                    if low <= limit + slack:
                        order += 1
                        heapq.heappush(queue, (low, order, dist, child))
        return sorted(((s, -v, -r) for s, v, r in best), key=lambda x: (-x[0], x[1], x[2]))


def whole_steps(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, kept within 64 bits; null where the vector is null or holds a null or non-finite one."""
    x = vector.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(rows: pa.Table) -> np.ndarray:
    col = rows.column("v").combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=1))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = col.flatten().to_numpy()
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """``found`` (query, ..., score, vec_id, row) with ``rank``, the first k of each query."""
    rank = F.expr("row_number() over (partition by query order by score desc, vec_id, row)")
    return found.drop("rank").withColumn("rank", rank).filter(F.col("rank") <= k)


def top_by_inner_product(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard: int = 8192, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best other rows.

    Vectors are dealt in shards of about ``shard`` rows, queries in blocks of about ``block``, by hashes of the rows. Each
    shard's M-tree is built once and stored. Then blocks meet shards in rounds, twice as many shards in each: a task
    searches one tree best-first for one block, and what a round has found bounds the searches of the next, so a query
    gives k rows or less for each tree, and few once its bound is good. Memory of a task is bounded by the two sizes,
    whatever the data, and no vector is favoured by a cluster, label or id.

    Vectors that are null, or hold null or non-finite components, take no part; neither do rows without an id. Rows that
    repeat an id, or are alike in full, are rows of their own: each is a candidate for all others and, if its id is
    divisible, a query. A vector shorter than others is followed by zeros. Ties go to the smaller id. Fewer than k others:
    all of them. Components, and scores before they are compared, are kept within 64 bits. Other columns are not read. An
    empty table gives no rows.
    """
    known = vectors.select(F.col(id_col).cast("long").alias("id"), whole_steps(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null")
    known = cut(known.withColumn("row", F.monotonically_increasing_id()))
    is_query = F.pmod("id", F.lit(every)) == 0
    n, n_queries = known.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = -(-max(1, n) // shard), -(-max(1, n_queries) // block)
    own = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")

    def build(rows: pa.Table) -> pa.Table:
        tree = MTree(_matrix(rows), rows.column("id").to_numpy(), rows.column("row").to_numpy())
        return pa.table({"shard": rows.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def meet(queries: pa.Table, trees: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(queries):
            asked = list(zip(queries.column("row").to_pylist(), queries.column("id").to_pylist(), _matrix(queries), queries.column("floor").to_pylist()))
            for blob in trees.column("tree"):
                tree = pickle.loads(blob.as_py())
                for row, query_id, query, floor in asked:
                    found += [(row, query_id, vec, other, score) for score, vec, other in tree.search(query, row, k, floor)]
        cols = list(zip(*found)) or [[]] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query", "query_id", "vec_id", "row", "score"), cols)})

    asked = known.filter(is_query).select(own(1, blocks).alias("block"), "row", "id", "v")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    best, done = None, 0
    with scratch(vectors.sparkSession) as keep:
        trees = keep(known.withColumn("shard", own(2, shards)).groupBy("shard").applyInArrow(build, "shard int, tree binary"))
        while done < shards:
            upto = min(shards, 2 * done + 1)
            if best is None:
                floored = asked.withColumn("floor", F.lit(None).cast("long"))
            else:
                floor = cut(best.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor")))
                floored = asked.join(floor, "row", "left")
            here = floored.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
            held = trees.filter((F.col("shard") >= done) & (F.col("shard") < upto)).select("shard", "tree", every_block)
            found = here.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(meet, "query long, query_id long, vec_id long, row long, score long")
            best = cut(_best(found if best is None else best.drop("rank").unionByName(found), k))
            done = upto
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
