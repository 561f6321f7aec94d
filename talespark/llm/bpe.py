"""Byte-level BPE: pre-tokenisation by class arrays and a transition scan, cached pair merging, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Symbols of the automaton. A symbol holds all the look-ahead that the split needs.
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, LAST, SPACE, RESET = range(9)
# States: what the character just read belongs to. ONE and TWO: so many more characters of a contraction follow.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, GLUED, ONE, TWO = range(8)
#: Pieces in each of the two generations of a worker's merge cache.
CACHE = 1 << 16
#: No token.
NONE = np.int64(1 << 40)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by symbol and state."""
    step, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SPACE, IN_SPACE)):
        step[symbol] = run
        start[symbol, run] = False
        if symbol != SPACE:
            start[symbol, GLUED] = False
    for symbol, rest in ((SHORT, ONE), (LONG, TWO)):  # an apostrophe inside a run of signs, or after a glued space, is a sign
        step[symbol] = rest
        step[symbol, [IN_OTHER, GLUED]] = IN_OTHER
        start[symbol, [IN_OTHER, GLUED]] = False
    step[GLUE], step[LAST], step[RESET] = GLUED, FRESH, FRESH
    for symbol in range(RESET):  # inside a contraction any character just counts down
        step[symbol, TWO], step[symbol, ONE] = ONE, FRESH
        start[symbol, [ONE, TWO]] = False
    return step, start


STEP, START = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """All compositions of the symbols' transition functions: (product table, state after each element by state).

    Elements 0 to 8 are the symbols themselves; product[a, b] is "a, then b".
    """
    known = [tuple(int(x) for x in STEP[k]) for k in range(9)]
    place = {f: k for k, f in enumerate(known)}
    for f in known:  # grows while it is read
        for g in known[:9]:
            if (h := tuple(g[x] for x in f)) not in place:
                place[h] = len(known)
                known.append(h)
    product = np.array([[place[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    return product, np.array(known, np.uint8)


PRODUCT, AFTER = _monoid()


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point, as the patterns of the tiktoken library have it: letter, number, white space (as SPACE) or other.

    What the library encodes of a text is what its pattern matches, so all code points in a row, with a one-class
    pattern and a vocabulary of bytes, give the members of the class. Half a second, once, on the driver; workers are sent
    the result, so their versions of Python do not matter.
    """
    import tiktoken  # on the driver only

    bytewise = {bytes([k]): k for k in range(256)}
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        coder = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=bytewise, special_tokens={})
        out[np.frombuffer(coder.decode_bytes(coder.encode_ordinary(points)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def _symbols(points: np.ndarray, resets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A symbol for each code point, by their ``classes``; ``resets`` are the places of the newlines put after each text."""
    out = classes[points]
    space = out == SPACE
    after = np.r_[space[1:], True]
    out[space & ~after] = LAST
    out[(points == 0x20) & ~after] = GLUE
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        wide = np.r_[points, 0, 0]
        one, two = wide[at + 1], wide[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[at[pair]] = LONG
    out[resets] = RESET
    return out


def token_starts(symbols: np.ndarray, width: int = 256) -> np.ndarray:
    """Where tokens start, by an associative scan over transition functions.

    The symbols are dealt in rows of ``width``. Up: the functions of each row are multiplied in their monoid. Across: the
    rows' products are chained, which gives the state at the head of each row. Down: each row is replayed from there.
    """
    n = len(symbols)
    rows = -(-n // width)
    grid = np.full(rows * width, RESET, np.intp)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    product, size = PRODUCT.ravel().astype(np.intp), len(PRODUCT)
    run = grid[0]
    for column in grid[1:]:
        run = product.take(run * size + column)
    state, heads = FRESH, np.zeros(rows, np.intp)
    for k, f in enumerate(run.tolist()):
        heads[k] = state
        state = AFTER[f, state]
    step, start, out = STEP.ravel().astype(np.intp), START.ravel(), np.empty(grid.shape, bool)
    for k, column in enumerate(grid):
        at = column * 8 + heads
        out[k] = start.take(at)
        heads = step.take(at)
    return out.T.ravel()[:n]


def pieces(texts: list[str], classes: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pre-tokens of all texts in a row, as UTF-8 slices: (slices, number of each slice's text, its byte offset there)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    resets = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(token_starts(_symbols(points, resets, classes)))
    size = np.r_[0, (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)).cumsum()]
    places = size[starts]
    cuts = places.tolist()
    blob = joined.encode("utf-8", "surrogatepass")
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, resets)] = False  # the newlines between texts are no part of them
    found = [blob[a:b] for a, b, k in zip(cuts, [*cuts[1:], len(blob)], own.tolist()) if k]
    of = np.searchsorted(resets, starts[own])
    return found, of, places[own] - size[np.r_[0, resets[:-1] + 1]][of]


class Pairs:
    """Ids that two ids join to, for all ways to cut a token in two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in found], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = np.r_[keys[order], np.int64(1 << 62)], np.r_[np.array(list(found.values()), np.int64)[order], NONE]
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        self.of_bytes = self.look(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each joined pair, or NONE; a negative id stands for no token."""
        want = np.where((a < 0) | (b < 0), np.int64(-1), a << 32 | np.maximum(b, 0))
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ids[at], NONE)


def merge_all(found: list[bytes], pairs: Pairs) -> list[np.ndarray]:
    """Ids of pieces of about one length, merged in step: in each piece the leftmost pair of the lowest rank joins until none can."""
    rows, sizes = len(found), np.array([len(p) for p in found])
    wide = int(sizes.max()) + 1
    raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in found), np.uint8).reshape(rows, wide)
    inside = np.arange(wide) < sizes[:, None]
    ids = np.where(inside, pairs.byte[raw], -1)
    scores = np.where(inside[:, 1:], pairs.of_bytes[raw[:, :-1], raw[:, 1:]], NONE)
    out: list = [None] * rows
    live = np.arange(rows)
    while len(live):
        k = scores.argmin(1)
        low = scores[np.arange(len(live)), k]
        if (over := low == NONE).any():
            for row, got in zip(live[over].tolist(), ids[over]):
                out[row] = got[got >= 0]
            live, ids, scores, k, low = live[~over], ids[~over], scores[~over], k[~over], low[~over]
            if not len(live):
                break
        at = np.arange(len(live))
        take = np.arange(ids.shape[1] - 1)
        ids = ids[at[:, None], take + (take > k[:, None])]
        take = take[:-1]
        scores = scores[at[:, None], take + (take > k[:, None])]
        ids[at, k] = low
        if scores.shape[1]:
            right = k < scores.shape[1]
            scores[at[right], k[right]] = pairs.look(low[right], ids[at[right], k[right] + 1])
            left = k > 0
            scores[at[left], k[left] - 1] = pairs.look(ids[at[left], k[left] - 1], low[left])
        else:
            scores = np.full((len(live), 1), NONE)
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge_all for one long piece, with a heap over linked parts, so a piece of n bytes costs n log n."""
    n = len(piece)
    end, back, live = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
    heap = [(ranks[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
    heapq.heapify(heap)

    def offer(a: int) -> None:
        if a >= 0 and end[a] < n and (rank := ranks.get(piece[a : end[end[a]]])) is not None:
            heapq.heappush(heap, (rank, a, end[end[a]]))

    while heap:
        _, a, b = heapq.heappop(heap)
        if not live[a] or end[a] == n or end[end[a]] != b or end[a] == b:
            continue
        live[end[a]] = 0
        end[a] = b
        if b < n:
            back[b] = a
        offer(a)
        offer(back[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


class Coder:
    """Encoder and decoder of one vocabulary; ``blob`` is the content of a rank file (base64 bytes, then rank), ``classes`` are char_classes() as bytes."""

    def __init__(self, blob: bytes, classes: bytes):
        self.classes = np.frombuffer(classes, np.uint8)
        self.ranks = {b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        top = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * top
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.sizes = np.array([len(t) for t in by_id], np.int64)  # of each id's bytes
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.pairs = Pairs(self.ranks)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, found: set[bytes]) -> None:
        """Bring all these pieces into the young generation of the cache."""
        if len(self.young) >= CACHE:
            self.young, self.old = {}, self.young
        young, old, groups = self.young, self.old, {}
        for p in found:
            if p in young:
                continue
            if (packed := old.get(p)) is not None:
                young[p] = packed
            elif p in self.ranks:
                young[p] = array("I", [self.ranks[p]]).tobytes()
            elif len(p) > 128:
                young[p] = array("I", _merge_long(p, self.ranks)).tobytes()
            else:
                groups.setdefault((len(p) - 1) // 8, []).append(p)
        for group in groups.values():
            for p, ids in zip(group, merge_all(group, self.pairs)):
                young[p] = ids.astype("<u4").tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, ends) of texts in a row: unsigned 32-bit ids, the byte offset in its text at which each token
        begins, and where each text's ids end.

        A slice's offset comes from the scan; within a slice each token begins where the one before it ends.
        """
        found, of, places = pieces(texts, self.classes)
        self._learn(set(found))
        packed = list(map(self.young.__getitem__, found))
        ids = np.frombuffer(b"".join(packed), "<u4")
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        begins = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        offsets = begins - np.repeat(begins[np.cumsum(counts) - counts] - places, counts)
        return ids, offsets, np.cumsum(np.bincount(of, counts, len(texts))).astype(np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of each text."""
        ids, offsets, ends = self.encode_all(texts)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield ids[a:b], offsets[a:b]

    def forget(self) -> None:
        """Empty the cache: workers outlive their tasks, and what they hold counts in later steps."""
        self.young, self.old = {}, {}

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of texts in a row: each token's are put at its offset in its text, a block of tokens at a time."""
        lasts = np.maximum(ends - 1, 0)
        some = np.diff(np.r_[0, ends]) > 0  # a text is as long as its last token reaches
        lengths = np.where(some, offsets[lasts] + self.sizes[ids[lasts]], 0) if len(ids) else np.zeros(len(ends), np.int64)
        heads = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint8)
        begin = offsets + np.repeat(heads, np.diff(np.r_[0, ends]))
        for at in range(0, len(ids), 1 << 16):
            now, start = ids[at : at + (1 << 16)], begin[at : at + (1 << 16)]
            size = self.sizes[now]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(start, size) + nth] = self.bytes[np.repeat(self.places[now], size) + nth]
        whole = out.tobytes()
        return [whole[a : a + n] for a, n in zip(heads.tolist(), lengths.tolist())]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of one text."""
        return self.decode_all(ids, offsets, np.array([len(ids)]))[0]


@lru_cache(2)
def _coder(blob: bytes, classes: bytes) -> Coder:
    return Coder(blob, classes)


def _shared(docs: DataFrame, path: str) -> Broadcast:
    """A vocabulary file and the classes of code points: their sizes do not follow the data."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), char_classes().tobytes()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, fields: str, make) -> DataFrame:
    """One pass over the texts; ``make`` turns a coder and some texts into the columns after the id."""
    shared = _shared(docs, path)
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):  # the arrays of a part take some fifty times its bytes
                texts = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, make(coder, texts))], ["doc_id", *names])
        coder.forget()

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {fields}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets): token ids of each whole text and the byte offset at which each token starts.

    ``path`` is a rank file on the driver. Special tokens are ordinary text. Null texts are empty; empty ones have empty
    lists. Rows are kept as they come, repeated or not; a null id stays null. Other columns are not read.
    """
    return _run(docs, path, id_col, text_col, "ids array<long>, offsets array<long>", lambda coder, texts: zip(*((ids.astype(np.int64), offsets) for ids, offsets in coder.encode(texts))))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids, offsets), as encode() gives them: each token's bytes are put at its offset.

    Null or empty ids give no bytes; an id that the vocabulary lacks is an error. Repeated rows and null ids of documents
    each get a row; other columns are not read; an empty table gives no rows.
    """
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                rows = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([coder.decode(np.array(x or [], np.int64), np.array(at or [], np.int64)) for x, at in rows], pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>"), F.col("offsets").cast("array<long>")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded, then decoded from ids and offsets alone.

    Same rules as encode(); the ids are digested as little-endian unsigned 32-bit integers, so long texts never leave
    the task that reads them.
    """

    def make(coder: Coder, texts: list[str]) -> tuple:
        ids, offsets, ends = coder.encode_all(texts)
        counts, raw = np.diff(np.r_[0, ends]), ids.tobytes()
        digests = [hashlib.sha256(raw[4 * (b - n) : 4 * b]).hexdigest() for b, n in zip(ends.tolist(), counts.tolist())]
        return counts, digests, [hashlib.sha256(x).hexdigest() for x in coder.decode_all(ids, offsets, ends)]

    return _run(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
