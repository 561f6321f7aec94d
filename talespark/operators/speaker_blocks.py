"""Speakers in stories of any length: the fold over blocks of lines, whose effects on the state are composed.

A fold needs the state that the lines before have left, so a story would be one task. But the state is small (last speaker,
subject, open speeches), and what a line does to it depends on names only through their gender and on whether they are
members of the cast. So a block of lines is a function of some hundred kinds of states, found by running the fold from all
of them at once; runs that meet go on as one, and after the first line that names a speaker there is one left. Functions
of neighbouring blocks compose, whichever are composed first, and give each block the state at its head.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespark.operators.speakers import OPEN_SPEECHES, OUTSIDER, Cast, Evidence, Fold, normal
from talespark.sources.shared import cut, kept

#: Marks of names that stand for the speaker and the subject at a block's head.
SPEAKER, SUBJECT = "\1speaker", "\1subject"
#: Lines at a block's end that are tried first: the state behind them mostly does not depend on what comes before.
LAST_LINES = 64


class Name(NamedTuple):
    """A known name and what the fold may ask of it."""

    name: str
    gender: str | None
    member: bool


class State(NamedTuple):
    """speaker and subject: a Name, "Narrator", or None; the subject may be OUTSIDER."""

    speaker: Name | str | None
    subject: Name | str | None
    open: int


START = State(None, None, 0)


def _kind(value: Name | str | None) -> tuple | str | None:
    return (value.gender, value.member) if isinstance(value, Name) else value


def kind_of(state: State) -> tuple:
    """What a block's effect depends on: the state without its names."""
    return _kind(state.speaker), _kind(state.subject), state.open


def _stand_ins(mark: str) -> list[Name]:
    return [Name(f"{mark} {str(g).lower()} {int(member)}", g, member) for g in ("M", "F", "U") for member in (False, True)]


def all_kinds(mode: str) -> list[State]:
    """A state of each kind that can be; names stand for those at the head.

    Who is taken for a speaker becomes the subject as well, and only the narrator then speaks without a change of subject:
    so a speaker with a name is the subject. Only modes that keep to the cast look at open speeches.
    """
    opens = range(OPEN_SPEECHES + 1) if mode != "generic" else (0,)
    pairs = [(None, None), *(("Narrator", b) for b in (None, "Narrator", OUTSIDER, *_stand_ins(SUBJECT))), *((n, n) for n in _stand_ins(SPEAKER))]
    return [State(a, b, n) for a, b in pairs for n in opens]


def _filled(value: Name | str | None, head: State) -> Name | str | None:
    if isinstance(value, Name):
        return head.speaker if value.name.startswith(SPEAKER) else head.subject if value.name.startswith(SUBJECT) else value
    return value


def applied(table: dict[tuple, State] | State, head: State) -> State:
    """The state behind a block, given the one at its head. A block's effect is a table, or a state if it is always the same."""
    if isinstance(table, State):
        return table
    end = table[kind_of(head)]
    return State(_filled(end.speaker, head), _filled(end.subject, head), end.open)


def composed(first: dict[tuple, State] | State, then: dict[tuple, State] | State) -> dict[tuple, State] | State:
    """The effect of two neighbouring blocks; associative."""
    if isinstance(then, State):
        return then
    if isinstance(first, State):
        return applied(then, first)
    return {kind: applied(then, mid) for kind, mid in first.items()}


class Teller:
    """The fold of one story's lines from given states."""

    def __init__(self, cast: Cast, options: dict):
        self.fold = Fold(cast, options["mode"], options["auto_assign"], options["initials"])
        self.cast, self.counts_open = cast, options["mode"] != "generic"
        self.told: dict[tuple[State, Evidence], State] = {}
        for name in (*_stand_ins(SPEAKER), *_stand_ins(SUBJECT)):  # known by kind, but found in no text
            cast.gender[name.name] = name.gender
            if name.member:
                cast.member_keys.add(name.name)

    def enter(self, state: State, before: str) -> None:
        name = lambda v: v.name if isinstance(v, Name) else v
        self.fold.speaker, self.fold.subject, self.fold.open, self.fold.before = name(state.speaker), name(state.subject), state.open, before

    def leave(self) -> State:
        def known(v: str | None) -> Name | str | None:
            return v if v in (None, "Narrator", OUTSIDER) else Name(v, self.cast.gender.get(normal(v)), self.cast.is_user(v))

        return State(known(self.fold.speaker), known(self.fold.subject), self.fold.open if self.counts_open else 0)

    def next(self, state: State, seen: Evidence) -> State:
        """The state after a line. Lines that say the same are told once for each state."""
        if (state, seen) not in self.told:
            if len(self.told) >= 1 << 16:
                self.told.clear()
            self.enter(state, "")
            self.fold.tell(seen)
            self.told[state, seen] = self.leave()
        return self.told[state, seen]

    def effect(self, rows: list[dict], after: dict | None, before: str, heads: list[State]) -> dict[tuple, State] | State:
        """What the lines do to each of the heads: a table by their kinds, or one state that all of them end in."""
        live: dict[State, list[State]] = {}
        for head in heads:
            live.setdefault(head, []).append(head)
        for row, then in zip(rows, [*rows[1:], after]):
            self.fold.before = before
            seen = self.fold.look(row, then)
            now: dict[State, list[State]] = {}
            for state, of in live.items():
                now.setdefault(self.next(state, seen), []).extend(of)
            live, before = now, (row["text"] or "").strip()
        table = {kind_of(head): state for state, of in live.items() for head in of}
        only = next(iter(live))
        own = not any(isinstance(v, Name) and v.name.startswith((SPEAKER, SUBJECT)) for v in only[:2])
        return only if len(live) == 1 and own else table


def _runs(table: pa.Table, block: int, size: int) -> list[tuple[int, dict]]:
    """(place relative to the block, line) in order; places before the first line and behind the last are of neighbours."""
    table = table.sort_by([("at", "ascending")])
    row = table.column("row").combine_chunks()
    fields = {c: row.field(c).to_pylist() for c in ("story_id", "text", "type", "raw", "attribution")}
    fields["raw"] = [text if same else raw for text, raw, same in zip(fields["text"], fields["raw"], table.column("same").to_pylist())]
    return [(at - block * size, dict(zip(fields, values))) for at, *values in zip(table.column("at").to_pylist(), *fields.values())]


class _Casts:
    """The casts of a block's stories, each made once for all stories that share it."""

    def __init__(self, context: pa.Table, options: dict):
        self.options, self.made, self.members = options, {}, {}
        for m in sorted(context.filter(pa.compute.is_valid(context.column("ord"))).to_pylist(), key=lambda m: m["ord"]):
            self.members.setdefault(m["story"], []).append((m["name"], m["gender"]))

    def of(self, story: object) -> Teller:
        key = tuple(self.members.get(story, self.options["shared"]))
        if key not in self.made:
            self.made[key] = Teller(Cast(list(key), self.options["catalog"]), self.options)
        return self.made[key]


def _effect_of_block(size: int, lead: int, options: dict):  # noqa: ANN202
    """(block, link, fixed, effect) of a block whose last story goes on in the next one, from its lines behind place ``lead``.

    link: the block before, on whose effect this one's is to be put; fixed: the effect is one state, whatever comes before.
    """

    def run(key: tuple, lines: pa.Table, context: pa.Table) -> pa.Table:
        block, out = key[0].as_py(), []
        rows = _runs(lines, block, size)
        if len(rows) > 1 and rows[-1][0] == size and rows[-2][1]["story_id"] == rows[-1][1]["story_id"]:
            after, rows = rows[-1][1], rows[:-1]
            first = len(rows)
            while first and rows[first - 1][1]["story_id"] == after["story_id"]:
                first -= 1
            inside = first > 0 or rows[0][0] > lead  # the story's own first line is here
            heads = [START] if inside else all_kinds(options["mode"])
            before = "" if inside else (rows[0][1]["text"] or "").strip()
            told = [r for at, r in rows[first:] if at > lead]
            teller = _Casts(context, options).of(after["story_id"])
            effect = teller.effect(told, after, before, heads)
            out.append((block, block - 1, isinstance(effect, State), pickle.dumps(effect)))
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("block", "link", "fixed", "effect"), cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))})

    return run


def _replay(size: int, options: dict):  # noqa: ANN202
    """The lines of a block with their speakers, from the state at its head."""

    def run(key: tuple, lines: pa.Table, context: pa.Table) -> pa.Table:
        block = key[0].as_py()
        lines = lines.sort_by([("at", "ascending")])
        rows, casts = _runs(lines, block, size), _Casts(context, options)
        heads = [h for h in context.column("head").to_pylist() if h is not None]
        out, kept, before = [], [], rows[0][1] if rows[0][0] < 0 else None
        for k, (at, row) in enumerate(rows):
            if not 0 <= at < size:
                continue
            after = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][1]["story_id"] == row["story_id"] else None
            if k == 0 or rows[k - 1][1]["story_id"] != row["story_id"]:
                teller = casts.of(row["story_id"])
                teller.enter(START, "")
            elif at == 0:
                teller = casts.of(row["story_id"])
                teller.enter(pickle.loads(heads[0]), (before["text"] or "").strip())
            out.append(teller.fold.step(row, after))
            kept.append(k)
        told = pa.array(kept, pa.int64())
        return pa.table([lines.column("row").take(told), lines.column("same").take(told), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string()))], names=["row", "same", "character", "candidates"])

    return run


def _resolved(effects: DataFrame) -> DataFrame:
    """``effects`` with all of them fixed: those that are not are put on their links', whose links they take over, so a chain of n takes log n rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [composed(pickle.loads(a), pickle.loads(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            cols = [batch.column(0), batch.column(1), pa.array([isinstance(e, State) for e in both], pa.bool_()), pa.array(list(map(pickle.dumps, both)), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "link", "fixed", "effect"])

    while not (left := effects.filter("not fixed")).isEmpty():
        to = effects.select(F.col("block").alias("link"), F.col("link").alias("next"), F.col("effect").alias("first"))
        met = left.select("block", "link", F.col("effect").alias("then")).join(to, "link").select("block", "next", "first", "then")
        effects = cut(effects.filter("fixed").unionByName(met.mapInArrow(run, "block long, link long, fixed boolean, effect binary")))
    return effects


def _raw() -> Column:
    """A line's raw text, which is kept once where it is its text."""
    return F.when(F.col("same"), F.col("row.text")).otherwise(F.col("row.raw"))


def _numbered(lines: DataFrame) -> DataFrame:
    """(at, row, same): all lines in the order of stories and line numbers, numbered without a gap.

    Sorted by ranges of (story, line number), so a long story lies in many parts; only the parts' row counts, one number
    for each part, come to the driver. Lines are written first, as Spark reads them twice to find the ranges. same: the raw
    text is the text, and null in the row (see _raw).
    """
    same = F.coalesce(F.col("raw") == F.col("text"), F.lit(False))
    columns = (F.when(~same, F.col("raw")).alias("raw") if c == "raw" else F.col(f"`{c}`") for c in lines.columns)
    named = lines.select(F.struct(*columns).alias("row"), same.alias("same"), F.monotonically_increasing_id().alias("own"))
    order = [F.col("row.story_id"), F.col("row.line_no").asc_nulls_last(), F.xxhash64("row.text", "row.type", _raw(), "row.attribution"), F.col("own")]
    with kept(named) as told:
        dealt = cut(told.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("place"), "row", "same"))
    part = F.shiftright("place", 33)
    counts = sorted(map(tuple, dealt.groupBy(part.alias("part")).count().collect()))
    starts, so_far = [], 0
    for k, n in counts:
        starts.append((k, so_far))
        so_far += n
    begun = dealt.sparkSession.createDataFrame(starts, "part long, start long")  # a row for each part
    return dealt.withColumn("part", part).join(F.broadcast(begun), "part").select((F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("at"), "row", "same")


def detect_speakers(lines: DataFrame, cast: DataFrame | list[tuple[str, str]], mode: str = "generic", auto_assign: bool = True, initials: bool = True, catalog: list[tuple[str, str]] | None = None, block_lines: int = 1024) -> DataFrame:
    """``lines`` with character and candidates. cast: (story_id, ord, name, gender), or names and genders that all stories share; catalog: (name, gender) known to all stories.

    mode "generic" lets any known name speak, "strict" only members of the cast by their names, "aggressive" also by their
    variants. The result is that of the fold over each story in the order of its line numbers, but a story is cut in blocks
    of ``block_lines``, so no task holds more, however long the story:

    1. Lines are sorted by ranges of story and line number and numbered; a block also gets the lines next to it.
    2. The effect of a block's last lines on each kind of state; where this depends on what comes before, that of the block.
    3. Effects that depend on the block before are composed with its effect, by pointer doubling, until none does.
    4. Each block is told from the state at its head.

    Every row comes back with its own columns: rows that repeat a line number are lines of their own, ordered by a hash of
    their content, and lines without a number come last. Rows without a story are one story with the catalog, or the
    shared cast. A null text is empty. An empty table gives no rows.
    """
    shared = [] if isinstance(cast, DataFrame) else list(cast)
    options = {"mode": mode, "auto_assign": auto_assign, "initials": initials, "catalog": catalog or [], "shared": shared}
    told = lines.drop("character", "candidates")
    numbered, size = _numbered(told), block_lines
    own, within = F.floor(F.col("at") / size).cast("long"), F.col("at") % size
    beside = F.array_compact(F.array(own, F.when((within == 0) & (F.col("at") > 0), own - 1), F.when(within == size - 1, own + 1)))
    dealt = numbered.withColumn("block", F.explode(beside))
    story = lines.schema["story_id"].dataType
    fields = T.StructType([T.StructField("block", T.LongType()), T.StructField("story", story), T.StructField("ord", T.LongType()), T.StructField("name", T.StringType()), T.StructField("gender", T.StringType()), T.StructField("head", T.BinaryType())])
    if shared:
        members = lines.sparkSession.createDataFrame([], fields)
    else:
        named = cast.filter("story_id is not null").select(F.col("story_id").cast(story).alias("story"), F.col("ord").cast("long").alias("ord"), "name", F.upper("gender").alias("gender"))
        here = numbered.select(own.alias("block"), F.col("row.story_id").alias("story")).distinct()
        members = here.join(named, "story").select("block", "story", "ord", "name", "gender", F.lit(None).cast("binary").alias("head"))
    shape = "block long, link long, fixed boolean, effect binary"

    def effects(rows: DataFrame, lead: int) -> DataFrame:
        return cut(rows.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(_effect_of_block(size, lead, options), shape))

    place, last = F.col("at") - F.col("block") * size, min(LAST_LINES, size)
    found = effects(dealt.filter(place >= size - last - 1), size - last - 1)
    open_yet = found.filter("not fixed")
    if size > last and not open_yet.isEmpty():
        # Eight bytes for each such block of lines are sent to all, so that no line of another block is shuffled.
        found = found.filter("fixed").unionByName(effects(dealt.join(F.broadcast(open_yet.select("block")), "block", "left_semi"), -1))
    heads = _resolved(found).select((F.col("block") + 1).alias("block"), F.lit(None).cast(story).alias("story"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("gender"), F.col("effect").alias("head"))
    result = T.StructType([T.StructField("row", numbered.schema["row"].dataType), T.StructField("same", T.BooleanType()), T.StructField("character", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType()))])
    done = dealt.groupBy("block").cogroup(members.unionByName(heads).groupBy("block")).applyInArrow(_replay(size, options), result)
    return done.select(*((_raw() if c == "raw" else F.col("row").getField(c)).alias(c) for c in told.columns), "character", "candidates")
