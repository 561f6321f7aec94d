"""The streamed speaker fold against the one over whole stories: lines out of order, gaps, late lines, restarts."""

import random
import time

from talespark.operators.speaker_blocks import detect_speakers
from talespark.streaming.streams import stream_speakers

CAST = [("Ann", "F"), ("Bob", "M")]
SHAPE = "story_id long, line_no long, text string, type string, raw string, attribution string"
TEXTS = ["Ann looked up.", "Bob's coat was wet.", "She nodded.", "Stay here.", "The rain went on.", "I know.", "Nobody came."]


def lines(draw, story, n):
    out = []
    for k in range(n):
        text, kind = draw.choice(TEXTS), draw.choice(["narration", "dialogue", "dialogue"])
        out.append((story, k, text, kind, text, draw.choice([None, None, "Bob said.", "she whispered."]) if kind == "dialogue" else None))
    return out


class Run:
    """A query over files of a folder, one file a batch, whose rows are kept over restarts."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options = spark, tmp_path, options
        self.files, self.rows = 0, []

    def add(self, rows):
        self.spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.files += 1

    def start(self):
        source = self.spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        told = stream_speakers(source, CAST, **self.options)

        def take(batch, n):
            self.rows += [tuple(r) for r in batch.collect()]

        return told.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", f"{self.path}/state").trigger(processingTime="300 milliseconds").start()

    def wait_for(self, count):
        q, until = self.start(), time.time() + 120
        while len(self.rows) < count and time.time() < until:
            time.sleep(0.3)
        q.stop()


def told(rows):
    """How many lines have the next one, and all before, among these."""
    count = 0
    for story in {r[0] for r in rows}:
        have, k = {r[1] for r in rows if r[0] == story}, 0
        while k in have and k + 1 in have:
            k += 1
        count += k
    return count


def batch(spark, rows):
    return {(r.story_id, r.line_no): r.character for r in detect_speakers(spark.createDataFrame(rows, SHAPE), CAST).collect()}


def test_any_order_over_a_restart_equals_the_batch(spark, tmp_path):
    draw = random.Random(4)
    rows = [x for story in (1, 2, None) for x in lines(draw, story, 14)]
    want = batch(spark, rows)
    draw.shuffle(rows)
    run = Run(spark, tmp_path, patience_ms=600_000)
    for part in (rows[:20], rows[20:37]):
        run.add(part)
    run.wait_for(before := told(rows[:37]))
    assert len(run.rows) == before > 0
    for part in (rows[37:39], rows[39:]):
        run.add(part)
    run.wait_for(told(rows))  # from the checkpoint
    got = {r[:2]: r[2] for r in run.rows}
    assert len(got) == len(run.rows) == len(want) - 3 > before and not any(r[3] for r in run.rows)
    assert got == {k: v for k, v in want.items() if k[1] < 13}  # a story's last line waits


def test_gaps_late_lines_and_the_last_line(spark, tmp_path):
    draw = random.Random(5)
    rows = lines(draw, 7, 8)
    run = Run(spark, tmp_path, patience_ms=400)
    run.add([r for r in rows if r[1] in (0, 1, 2, 5, 6)])
    run.wait_for(5)  # the timer passes over the gap and lets the last line go
    told = [r for r in rows if r[1] not in (3, 4)]
    want = batch(spark, told[:-1])
    assert {r[:2]: r[2] for r in run.rows} == want and len(run.rows) == 5
    run.add([rows[3], (7, None, "?", "dialogue", "?", None), rows[7]])
    run.wait_for(8)
    assert sorted((r[1] is None, r[1], r[3]) for r in run.rows[5:]) == [(False, 3, True), (False, 7, False), (True, None, True)]
    assert run.rows[5:] and all(r[2] is None for r in run.rows if r[3])
