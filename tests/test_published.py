"""Two-phase publishing: what is committed is there once; attempts that fail, repeat or are killed leave nothing to see."""

import glob
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talespark.sources.published import Published, manifests, read_published, resume_after, write_published
from talespark.streaming.streams import resumable_sink

SHAPE = "project_id string, idx long, text string"


def entries(spark, a, b, parts=3):
    return spark.range(a, b, 1, parts).select(F.concat(F.lit("p"), F.col("id") % 2).alias("project_id"), F.col("id").alias("idx"), F.lit("é\n").alias("text"))


def seen(spark, path):
    return sorted(r.idx for r in read_published(spark, path, SHAPE).collect())


def test_rows_appear_with_their_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    assert resume_after(spark, path) == -1 and seen(spark, path) == [] and manifests(spark, path).count() == 0
    write_published(entries(spark, 0, 10), path, "idx", "first")
    write_published(entries(spark, 10, 14), path, "idx", "second")
    write_published(entries(spark, 0, 10), path, "idx", "first")  # the same run again
    write_published(entries(spark, 0, 0), path, "idx", "none")
    assert seen(spark, path) == list(range(14)) and resume_after(spark, path) == 13
    got = {r.name: (r.rows, r.committed_index) for r in manifests(spark, path).collect()}
    assert got == {"first": (10, 9), "second": (4, 13), "none": (0, None)}
    assert {r.text for r in read_published(spark, path, "text string").collect()} == {"é\n"}
    files = {f for r in manifests(spark, path).collect() for f in r.files}
    assert {os.path.basename(f) for f in glob.glob(f"{path}/data/*")} == files  # those of the repeated run are gone


def test_a_failed_job_leaves_nothing_to_see(spark, tmp_path):
    path = str(tmp_path / "out")
    write_published(entries(spark, 0, 5), path, "idx", "good")
    bad = entries(spark, 5, 50).withColumn("text", F.when(F.col("idx") == 49, F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        write_published(bad, path, "idx", "bad")
    assert seen(spark, path) == list(range(5)) and resume_after(spark, path) == 4
    write_published(entries(spark, 5, 50), path, "idx", "bad")
    assert seen(spark, path) == list(range(50))
    with pytest.raises(Exception, match="append"):
        entries(spark, 0, 1).write.format("published").mode("overwrite").save(path)


def test_repeated_attempts_and_killed_commits(tmp_path):
    """The protocol itself: a task tried twice, a commit that dies before its manifest, one that is repeated after it."""
    source = Published({"path": str(tmp_path / "out"), "indexcolumn": "idx", "name": "q"})
    rows = lambda *k: iter([pa.RecordBatch.from_pydict({"idx": list(k)})])
    writer = source.streamWriter(None, False)
    lost, kept = writer.write(rows(1, 2)), writer.write(rows(1, 2))  # an executor died after its first attempt had written
    writer.commit([kept, None], 0)
    (tmp_path / "out" / "manifests" / "q-000000000001.json.abc.tmp").write_text("{")  # killed while a manifest was written
    again = writer.write(rows(9))
    writer.commit([again], 0)  # the batch ran again after its commit
    gone = writer.write(rows(7))
    writer.abort([gone, None], 2)
    read = {f["files"][0] for f in writer.place.manifests().values()}
    assert read == {kept.file} and kept.index == 2
    assert {os.path.basename(f) for f in glob.glob(f"{tmp_path}/out/data/*")} == {lost.file, kept.file}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "out")

    def drain():
        source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        assert resumable_sink(source, path, str(tmp_path / "check"), once=True, index_column="idx").awaitTermination(120)

    for a, b in ((0, 4), (4, 9)):
        entries(spark, a, b, 1).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    assert seen(spark, path) == list(range(9)) and resume_after(spark, path) == 8
    entries(spark, 9, 12, 1).write.mode("append").parquet(f"{tmp_path}/in")
    last = max(glob.glob(f"{tmp_path}/check/commits/*"), key=lambda f: int(os.path.basename(f)) if os.path.basename(f).isdigit() else -1)
    os.remove(last)  # as if the driver had died between the sink's commit and Spark's own: the batch runs again
    for crc in glob.glob(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    drain()
    assert seen(spark, path) == list(range(12)) and [r.batch for r in manifests(spark, path).orderBy("batch").collect()] == [0, 1, 2]
