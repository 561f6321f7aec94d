"""Streams of log lines, resumable entries and story lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from talespark.operators.logs import LEVELS, parse_log
from talespark.operators.speakers import Cast, Fold
from talespark.sources.published import Published

#: What the speaker fold reads of a line.
LINE = ("text", "type", "raw", "attribution")


def level_counts(lines: DataFrame, window: str = "5 minutes", late: str = "10 minutes", column: str = "value") -> DataFrame:
    """(window, level, lines) over event time; lines later than ``late`` are left out."""
    rows = parse_log(lines, column).filter(F.col("ts").isNotNull() & F.col("level").isin(*LEVELS))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window), "level").agg(F.count("*").alias("lines"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_window, user_id, events): a session ends after ``gap`` without an event. An addition of this library."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))


def resumable_sink(entries: DataFrame, path: str, checkpoint: str, every: str = "120 seconds", once: bool = False, index_column: str | None = None, name: str = "stream") -> StreamingQuery:
    """Publish new entries batch by batch in two phases (published.Published); a restart goes on after the last committed batch, a repeated batch changes nothing."""
    entries.sparkSession.dataSource.register(Published)
    options = {"path": path, "checkpointLocation": checkpoint, "name": name} | ({"indexColumn": index_column} if index_column else {})
    writer = entries.writeStream.format("published").options(**options)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class SpeakerProcessor(StatefulProcessor):
    """The speaker fold of one story, line by line in the order of line numbers, whatever the order in which lines come.

    State: the fold's own few fields with the number due next, and the lines that wait. A line is told once the next one is
    here, which may hold its attribution. A timer tells what still waits when no line has come for ``patience_ms``: numbers
    that never came are passed over then, and the story's last line is not kept back. State goes after ``forget_ms`` without
    a change. Lines that come behind what has been told come out without a speaker, marked late.
    """

    def __init__(self, cast: list[tuple[str, str]], mode: str, patience_ms: int, forget_ms: int):
        self.cast, self.mode, self.patience_ms, self.forget_ms = cast, mode, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "speaker string, subject string, open int, before string, due long", self.forget_ms)
        self.waiting = handle.getMapState("waiting", "line_no long", "text string, type string, raw string, attribution string", self.forget_ms)

    def _tell(self, key: tuple, lines: dict[int, dict], all_of_them: bool) -> list[Row]:
        """Tell what can be told of ``lines``, waiting ones included, and keep the rest."""
        fold, due, out = Fold(Cast(self.cast), self.mode), 0, []
        if self.told.exists():
            fold.speaker, fold.subject, fold.open, fold.before, due = self.told.get()
        stored = set()
        for (number,), values in self.waiting.iterator():
            stored.add(number)
            lines.setdefault(number, dict(zip(LINE, values)))
        for number in sorted(lines):
            if number < due:
                out.append(Row(story_id=key[0], line_no=number, character=None, late=True))
                del lines[number]
        for number in sorted(lines):
            after = lines.get(number + 1)
            if number != due and not all_of_them or after is None and not all_of_them:
                break
            if after is None:  # a gap, or the end
                after = lines[min(n for n in lines if n > number)] if any(n > number for n in lines) else None
            out.append(Row(story_id=key[0], line_no=number, character=fold.step(lines[number], after)[0], late=False))
            due = number + 1
        self.told.update((fold.speaker, fold.subject, fold.open, fold.before, due))
        for number in stored - {n for n in lines if n >= due}:
            self.waiting.removeKey((number,))
        for number in lines.keys() - stored:
            if number >= due:
                self.waiting.updateValue((number,), tuple(lines[number][c] for c in LINE))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        lines: dict[int, dict] = {}
        for row in rows:
            number = row["line_no"]
            if number is None or number in lines or self.waiting.containsKey((number,)):
                yield Row(story_id=key[0], line_no=number, character=None, late=True)
            else:
                lines[number] = {c: row[c] for c in LINE}
        yield from self._tell(key, lines, False)
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._tell(key, {}, True)


def stream_speakers(lines: DataFrame, cast: list[tuple[str, str]], mode: str = "generic", patience_ms: int = 30_000, forget_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(story_id, line_no, character, late): the speaker fold over a stream of lines, numbered from 0 in each story; see SpeakerProcessor.

    Equal to detect_speakers() on the same lines, in any order and over restarts, as long as no gap lasts ``patience_ms``.
    A number that a story has had before is late. The session's state store is set to RocksDB, which this needs. Timers
    are processing time, so a run goes on after the last input: stop it, or trigger it by time.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = lines.select(F.col("story_id").cast("long").alias("story_id"), F.col("line_no").cast("long").alias("line_no"), *LINE)
    return told.groupBy("story_id").transformWithState(SpeakerProcessor(cast, mode, patience_ms, forget_ms), "story_id long, line_no long, character string, late boolean", "append", "processingTime")
