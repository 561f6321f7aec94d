"""Exact removal of repeated byte strings, found by suffix sorting of the places where texts can agree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import PART, Hashes, _scramble, anchors
from .common import bound_batches, cut, scratch, short_lived_shuffles, slices
from .gsaca import common_prefixes, suffix_arrays

#: Bytes hashed at an anchor. Windows of 200 bytes then have a hundred places for their anchor.
GRAM = 101
#: Window starts that a slice of an anchor's surroundings stands for; then those of its parts.
WIDTHS = (20, 5, 1)
#: Bits of the sieves that spare later passes most places; a full sieve only spares nothing.
SIEVE_BITS = 27
#: Strings around one core that are sorted together; larger groups are cut into parts of their slices.
GROUP = 400


def _keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text's content."""
    return F.xxhash64(text), F.xxhash64(F.lit("content"), text)


def _base(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = _keys(text)
    return docs.select(k1.alias("k1"), k2.alias("k2"), text.cast("binary").alias("text"))


def sieve(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** SIEVE_BITS bits in which each value's low bits are set; at most 32 MB reach the driver, whatever the data."""
    with short_lived_shuffles(df.sparkSession):
        words = df.select(F.expr(f"shiftright({column} & {(1 << SIEVE_BITS) - 1}L, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64((1 << SIEVE_BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


class _Part:
    """Some texts laid end to end, their anchors, and hashes of any of their strings."""

    def __init__(self, part: pa.RecordBatch, span: int):
        raw = part.column(2).to_pylist()
        self.k1, self.k2 = (part.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(x) for x in raw])
        self.at, self.h = anchors(self.data, self.ends, span, GRAM)
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.head, self.tail = (self.ends - [len(x) for x in raw])[self.doc], self.ends[self.doc]
        with np.errstate(over="ignore"):
            self.own = _scramble(self.k1[self.doc] ^ _scramble(self.k2[self.doc] + (self.at - self.head).astype(np.uint64)))

    def keep(self, mask: np.ndarray) -> None:
        for name in ("at", "doc", "head", "tail", "h", "own"):
            setattr(self, name, getattr(self, name)[mask])


def _scan(base: DataFrame, span: int, schema: str, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for part in slices(batch, 2, PART):
                cols = make(_Part(part, span))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names)

    return base.mapInArrow(run, schema)


def _slices_of(x: _Part, span: int, width: int) -> dict[str, np.ndarray]:
    """Slices of each anchor's surroundings: all windows of slice q start between q * width and (q + 1) * width - 1 bytes before the anchor."""
    core = span - width + 1
    count = -(-(span - GRAM + 1) // width)
    begin = (x.at[:, None] - width * np.arange(count)).ravel()
    row = np.repeat(np.arange(len(x.at)), count)
    inside = (begin >= x.head[row]) & (begin + core <= x.tail[row])
    begin, row = begin[inside], row[inside]
    with np.errstate(over="ignore"):
        own = _scramble(x.k1[x.doc[row]] ^ _scramble(x.k2[x.doc[row]] + ((begin - x.head[row]) << 1).astype(np.uint64) + np.uint64(1)))
    return {"begin": begin, "row": row, "own": own, "core1": Hashes(x.data, 3).of(begin, begin + core)}


def _two_owners(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by two owners or more, with the least and the greatest: a partial aggregation, whatever a key's share of the rows."""
    return df.groupBy(*keys).agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high")


def _sorted_spans(width: int, span: int) -> Callable:
    """Which windows repeat within groups of strings around one core; rows (core1, core2, left, right, copies) come sorted by core.

    A string is what lies left of the core, the core as one symbol, and what lies right of it; one that occurs at two
    places or more stands in its group twice. A window that starts d bytes left of the core repeats if the suffix that
    starts there agrees with a neighbour in the suffix array for ``width`` symbols: the d bytes, the core, and the
    width - 1 - d bytes that complete the window. Each string with such windows is given with its least and greatest d.
    """

    def solve(groups: list, out: list) -> None:
        rows = [r for g in groups for r in g for _ in range(r[4])]
        lefts, rights = (np.array([len(r[k]) for r in rows]) for k in (2, 3))
        counts = np.array([sum(r[4] for r in g) for g in groups])
        raw = b"".join(x for g in groups for r in g for x in (r[2] + b"\0" + r[3] + b"\0",) * r[4])
        # Each string: left, core, right, separator; each group ends with one more symbol, the least.
        text = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
        stops = np.cumsum(lefts + rights + 2)
        text[stops - 1] = 1
        text[stops - 2 - rights] = 258
        text = np.insert(text, stops[np.cumsum(counts) - 1], 0)
        nth = np.repeat(np.arange(len(groups)), counts)
        sizes = np.bincount(nth, lefts + rights + 2).astype(np.int64) + 1
        order = suffix_arrays(text, sizes)
        agree = common_prefixes(text, order, 2, width)
        longest = np.zeros(len(text), np.int64)
        longest[order] = np.maximum(agree, np.r_[0, agree[:-1]])
        center = np.flatnonzero(text == 258)
        back = center[:, None] - np.arange(width)
        hit = (np.arange(width) <= lefts[:, None]) & (longest[np.maximum(back, 0)] >= width)
        some = hit.any(1)
        first, last = hit.argmax(1), width - 1 - hit[:, ::-1].argmax(1)
        before = None
        for k in np.flatnonzero(some).tolist():
            if rows[k] is not before:  # the second copy says the same
                out.append((*rows[k][:4], int(first[k]), int(last[k])))
                before = rows[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        symbols: dict[int, int] = {}
        out: list = []
        key, group = None, []

        def close() -> None:
            if group:
                here = sum((len(r[2]) + len(r[3]) + 2) * r[4] for r in group)
                kind = here.bit_length()  # groups of about one size go in step
                waiting.setdefault(kind, []).append(list(group))
                symbols[kind] = symbols.get(kind, 0) + here
                if symbols[kind] > 200_000:
                    solve(waiting.pop(kind), out)
                    symbols[kind] = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 6
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["core1", "core2", "left", "right", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row[:2] != key:
                    close()
                    key, group = row[:2], []
                group.append(row)
            yield flush()
        close()
        for groups in waiting.values():
            solve(groups, out)
        yield flush()

    return run


def _sorted_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings that repeat; rows (h, l2, l1, r1, r2, low, high) come sorted by h, the hash of what lies in the middle.

    Surroundings are strings of five symbols, their pieces. Each stands in the group of its h once for each of the places
    low and high, so once if these are one. They repeat if the suffix that is all of them agrees with a neighbour in all
    five: a lone place has no such neighbour.
    """
    held: np.ndarray | None = None

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        n = len(rows)
        named = np.unique(rows[:, :5], return_inverse=True)[1].reshape(n, 5)[:, [1, 2, 0, 3, 4]] + 2
        copies = 1 + (rows[:, 5] != rows[:, 6])
        strings = np.repeat(np.c_[named, np.ones(n, np.int64)], copies, axis=0)
        upto = np.cumsum(copies)
        # Groups of one h, in parts of GROUP rows at most; each ends with one more symbol, the least.
        heads = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        place = np.arange(n) - np.repeat(heads, np.diff(np.r_[heads, n]))
        stops = upto[np.flatnonzero(np.r_[(place[1:] % GROUP) == 0, True])]
        text = np.insert(strings.ravel(), stops * 6, 0)
        order = suffix_arrays(text, np.diff(np.r_[0, stops]) * 6 + 1)
        agree = common_prefixes(text, order, 2, 5)
        longest = np.zeros(len(text), np.int64)
        longest[order] = np.maximum(agree, np.r_[0, agree[:-1]])
        own = upto - copies
        found = rows[longest[own * 6 + np.searchsorted(stops, own, "right")] >= 5]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(6)], ["h", "l2", "l1", "r1", "r2", "low"])

    for batch in batches:
        for at in range(0, len(batch), 1 << 15):
            part = batch.slice(at, 1 << 15)
            rows = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(7)], 1)
            rows = rows if held is None else np.concatenate((held, rows))
            # The last h may go on; one that has filled a part need not be held whole.
            cut_at = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left")) if len(rows) else 0
            cut_at += (len(rows) - cut_at) // GROUP * GROUP
            held = rows[cut_at:]
            if cut_at:
                yield solve(rows[:cut_at])
    if held is not None and len(held):
        yield solve(held)


def _of_several(places: DataFrame, several: DataFrame) -> DataFrame:
    """The surroundings of anchors that have others too. Where all places of an anchor have the same, all windows there are decided."""
    return places.select("h", "low").join(several.select("h"), "h", "left_semi")


def _narrower(rows: DataFrame, width: int, part: int, span: int) -> DataFrame:
    """The slices of ``width`` window starts cut into slices of ``part`` starts, each with its own, longer core."""
    q = F.explode(F.sequence(F.lit(0), F.lit(width // part - 1))).alias("q")
    cutup = rows.select("*", q).withColumn("a", F.col("q") * part).withColumn("b", F.lit(width - part) - F.col("a"))
    cutup = cutup.filter((F.length("left") >= F.col("a")) & (F.length("right") >= F.col("b")))
    left, right = F.expr("substring(left, length(left) - a + 1, a)"), F.expr("substring(right, 1, b)")
    rest = F.expr(f"substring(left, greatest(1, length(left) - a - {part - 1} + 1), least({part - 1}, length(left) - a))")
    after = F.expr(f"substring(right, b + 1, {part - 1})")
    return cutup.select(F.xxhash64("core1", "a", left, right).alias("core1"), F.xxhash64("core2", "b", right, left).alias("core2"), rest.alias("left"), after.alias("right"), "k1", "k2", (F.col("begin") - F.col("a")).alias("begin"), F.xxhash64("own", "q").alias("own"))


def repeated_spans(docs: DataFrame, span: int = 200, text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each content with repeated windows, intervals (start, end) whose union is all they cover.

    A window is ``span`` bytes within one text; it repeats if it also starts anywhere else. Contents are named by _keys;
    copies of a text are one content that repeats whole. All other windows are decided by suffix sorting; hashes only
    bring together what is sorted, by partial aggregations:

    1. Anchors whose hash no other place has go: no window that holds them repeats. A sieve passes on the others.
    2. Surroundings of an anchor, all windows that can hold it, are strings of five symbols, the hashes of five pieces.
       They are suffix-sorted in groups around the anchor, a string with one place once and one with more twice; those
       that agree with a neighbour in all symbols repeat with all their windows, at all their places.
    3. Where an anchor has several surroundings, one place of each is cut into slices of 20 window starts around a core of
       181 bytes. Slices whose core is unique go, again by a sieve and then exactly.
    4. Strings around a core are suffix-sorted byte by byte, each distinct one once or, if it has more places, twice, in
       groups of up to GROUP; larger groups are cut into narrower slices (20, 5, 1 starts) first. What the order says of
       a string holds for all its places.

    So no task holds more than GROUP strings of a core, and no window is compared with all that share its passage.
    """
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return _repeated_spans(docs, span, text_col, keep)


def _decided(rows: DataFrame, span: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k1, k2, start, end): intervals of repeated windows, of rows (core1, core2, left, right, k1, k2, begin, own)."""
    core, string = ["core1", "core2"], ["core1", "core2", "left", "right"]
    found = None
    for k, width in enumerate(WIDTHS):
        rows = keep(rows)
        # Aggregates are written before they are joined: then both sides of a join are plain exchanges, which Spark can split where a key is hot.
        alike = keep(rows.groupBy(*string).agg(F.when(F.min("own") == F.max("own"), 1).otherwise(2).alias("copies")))
        groups = keep(alike.groupBy(*core).agg(F.sum("copies").alias("n")).filter("n > 1"))
        asked = alike.join(groups.filter(F.col("n") <= GROUP).drop("n"), core, "left_semi").select(*string, "copies")
        hits = keep(asked.repartition(*core).sortWithinPartitions(*core).mapInArrow(_sorted_spans(width, span), "core1 long, core2 long, left binary, right binary, first int, last int"))
        here = rows.join(hits, string).select("k1", "k2", (F.col("begin") - F.col("last")).alias("start"), (F.col("begin") - F.col("first") + span).alias("end"))
        found = here if found is None else found.unionByName(here)
        large = groups.filter(F.col("n") > GROUP)
        if width == 1 or large.isEmpty():
            break
        rows = _narrower(rows.join(large.drop("n"), core, "left_semi"), width, WIDTHS[k + 1], span)
    return found


def _repeated_spans(docs: DataFrame, span: int, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    base = _base(docs, text_col)
    spark = docs.sparkSession
    wide = span - GRAM

    def grams(x: _Part) -> tuple:
        return x.h, x.own

    shared = spark.sparkContext.broadcast(sieve(_two_owners(_scan(base, span, "h long, own long", grams), "h"), "h"))

    def surroundings(x: _Part) -> tuple:
        x.keep(_passes(shared.value, x.h))
        start, end, after = np.maximum(x.at - wide, x.head), np.minimum(x.at + span, x.tail), x.at + GRAM
        middle, beyond = np.maximum(x.at - wide // 2, start), np.minimum(after + wide // 2, end)
        of = Hashes(x.data, 2).of
        return x.h, of(start, middle), of(middle, x.at), of(after, beyond), of(beyond, end), x.own, x.k1[x.doc], x.k2[x.doc], start - x.head, end - x.head

    pieces = ["h", "l2", "l1", "r1", "r2"]
    # Read twice below; some 80 bytes a place are cheaper to write than to find again.
    rows = keep(_scan(base, span, "h long, l2 long, l1 long, r1 long, r2 long, own long, k1 long, k2 long, start long, end long", surroundings))
    shared.unpersist()
    places = keep(rows.groupBy(*pieces).agg(F.min("own").alias("low"), F.max("own").alias("high")))
    several = keep(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    # An anchor hash with very many surroundings is dealt in parts, in which a task sorts GROUP of them at most at a time.
    common = several.filter(F.col("n") > GROUP)
    dealt = places.join(common, "h", "left").withColumn("part", F.pmod(F.xxhash64("low"), F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1))))
    sure = keep(dealt.repartition("h", "part").sortWithinPartitions("h").select(*pieces, "low", "high").mapInArrow(_sorted_surroundings, "h long, l2 long, l1 long, r1 long, r2 long, low long"))
    covered = rows.join(sure.select(*pieces), pieces).select("k1", "k2", "start", "end")
    # low is the only place of surroundings that do not repeat, and one place of those that do.
    border = spark.sparkContext.broadcast(sieve(_of_several(places, several), "low"))

    def cores(x: _Part) -> tuple:
        x.keep(_passes(border.value, x.own))
        s = _slices_of(x, span, WIDTHS[0])
        return s["core1"], s["own"]

    again = spark.sparkContext.broadcast(sieve(_two_owners(_scan(base, span, "core1 long, own long", cores), "core1"), "core1"))

    def strings(x: _Part) -> tuple:
        x.keep(_passes(border.value, x.own))
        s = _slices_of(x, span, WIDTHS[0])
        good = _passes(again.value, s["core1"])
        begin, row, own, core1 = (s[k][good] for k in ("begin", "row", "own", "core1"))
        size, more = span - WIDTHS[0] + 1, WIDTHS[0] - 1
        data, end = x.data.tobytes(), begin + size
        low, high = np.maximum(begin - more, x.head[row]).tolist(), np.minimum(end + more, x.tail[row]).tolist()
        left = pa.array([data[a:b] for a, b in zip(low, begin.tolist())], pa.binary())
        right = pa.array([data[a:b] for a, b in zip(end.tolist(), high)], pa.binary())
        return core1, Hashes(x.data, 4).of(begin, end), left, right, x.k1[x.doc[row]], x.k2[x.doc[row]], begin - x.head[row], own

    fields = "core1 long, core2 long, left binary, right binary, k1 long, k2 long, begin long, own long"
    decided = _decided(_scan(base, span, fields, strings).distinct(), span, keep)
    spans = covered.unionByName(decided)
    copies = base.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("end")).filter((F.col("n") > 1) & (F.col("end") >= span))
    out = cut(_runs(spans.unionByName(copies.select("k1", "k2", F.lit(0).cast("long").alias("start"), "end"))))
    for sent in (border, again):  # all that read them is written
        sent.unpersist()
    return out


def _runs(spans: DataFrame) -> DataFrame:
    """(k1, k2, spans): the maximal runs of each content's intervals, in order; a content has at most as many as it has bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            flat = col.flatten()
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            of = np.repeat(np.arange(len(batch)), np.diff(col.offsets.to_numpy()))
            order = np.lexsort((start, of))
            of = of[order]
            base = of << 40  # texts are shorter, so one running maximum serves all
            reach = np.maximum.accumulate(end[order] + base)
            heads = np.flatnonzero(start[order] + base > np.r_[-1, reach[:-1]])
            lasts = np.r_[heads[1:], len(reach)] - 1
            counts = np.bincount(of[heads], minlength=len(batch))
            found = pa.StructArray.from_arrays([pa.array(start[order][heads]), pa.array(reach[lasts] - base[lasts])], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), found)], ["k1", "k2", "spans"])

    held = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return held.mapInArrow(run, "k1 long, k2 long, spans array<struct<start: long, end: long>>")


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of the union, in order."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _aligned(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to whole UTF-8 characters."""
    out = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _touched(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (row, text) with k1 and k2, parted in those that may have spans and those that have none, by a bitmap.

    The bitmap has 131072 words at most, so broadcasting it is safe at any size; texts without spans are never shuffled.
    """
    words = spans.groupBy(F.expr("shiftright(k1 & 8388607L, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k1 & 63 as int))")).alias("bits"))
    k1, k2 = _keys(F.col("text"))
    met = rows.withColumns({"k1": k1, "k2": k2}).withColumn("word", F.expr("shiftright(k1 & 8388607L, 6)")).join(F.broadcast(words), "word", "left")
    maybe = F.coalesce(F.expr("shiftright(bits, cast(k1 & 63 as int)) & 1L"), F.lit(0).cast("long")) == 1
    return met.filter(maybe).drop("word", "bits"), met.filter(~maybe).drop("word", "bits")


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): all columns of ``docs`` as one, whatever their names, and the text that is looked at."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(whole.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def digest_repeats(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row: what removal of repeated spans leaves of its text.

    Texts are their UTF-8 bytes; each row is a text of its own, so a row that repeats another's text of ``span`` bytes or
    more loses all. Null texts are empty; shorter texts lose nothing; null ids stay null; an empty table gives no rows;
    other columns are not read.
    """
    known = docs.select(F.col(id_col).cast("long").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(known, span, "text")
    touched, rest = _touched(known, spans)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    runs = merged(found)
                    out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_without(text, runs)).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*out))], names)

    met = touched.join(spans, ["k1", "k2"], "left").select("row", F.col("text").cast("binary").alias("text"), "spans")
    done = met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    return done.unionByName(rest.select(F.col("row").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")))


def strip_repeats(docs: DataFrame, span: int = 200, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated spans cut out of ``text_col``, other columns as they are (``length_col``, if there, counted anew
    where a text has changed).

    Spans are drawn in to whole characters, so what is left is text. Rows stay, even those that lose all. Null texts
    stay null, empty and shorter ones as they are; of equal texts of ``span`` bytes or more every row loses all. Columns
    may have any names. An empty table gives no rows.
    """
    spans = repeated_spans(docs, span, text_col)
    touched, rest = _touched(_rows(docs, text_col), spans)

    @F.pandas_udf("string")
    def strip(text, found):  # noqa: ANN001, ANN202
        def one(t, f):  # noqa: ANN001, ANN202
            raw = t.encode()
            return _without(raw, _aligned(raw, merged(f))).decode()

        return text.combine(found, lambda t, f: one(t, list(f)) if f is not None else t)

    met = touched.join(spans, ["k1", "k2"], "left").withColumn("left", F.when(F.col("spans").isNotNull(), strip(F.col("text"), F.col("spans"))))

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == text_col:
            return F.when(F.col("left").isNull() | own.isNull(), own.cast("string")).otherwise(F.col("left")).cast(docs.schema[c].dataType).alias(c)
        if c == length_col:
            return F.when(F.col("left").isNull(), own).otherwise(F.length("left").cast(docs.schema[c].dataType)).alias(c)
        return own.alias(c)

    return met.select(*map(column, docs.columns)).unionByName(rest.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
