"""Helpers shared by the corpus operators: shared-folder checkpoints, table reads, bounded Arrow slices."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talespark.sources.shared import bound_batches  # noqa: F401

#: Characters that separate words everywhere in this subpackage.
SEPARATORS = " \t\n\x0b\x0c\r"
#: One word, as a Java or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set from ``spark.checkpoint.dir``.

    Only a single-machine session without that setting (tests) gets a temporary folder; on a cluster
    the setting is needed, as no other folder is known to be shared.
    """
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the DataFrames made and run within go when their action ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    with short_lived_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a DataFrame as Parquet in the shared folder and rereads it; all of it is deleted at the end.

    For large intermediate tables: as cut(), but compressed.
    """
    with scratch_folder(spark) as folder:

        def keep(df: DataFrame) -> DataFrame:
            path = f"{folder}/{uuid4()}"
            with short_lived_shuffles(spark):
                df.select("*").write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        yield keep


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """The name of a new folder in the shared one, deleted at the end with all that was written there."""
    folder = f"{checkpoint_dir(spark)}/scratch-{uuid4()}"
    try:
        yield folder
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Delete a folder of the shared file system, now or when the session's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        system.deleteOnExit(place)
    else:
        system.delete(place, True)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``column`` holds about ``most`` bytes or a single row, so memory follows bytes, not rows."""
    col = batch.column(column)
    start = 0
    while start < len(batch):
        n = len(batch) - start
        while n > 1 and col.slice(start, n).nbytes > most:
            n = (n + 1) // 2
        yield batch.slice(start, n)
        start += n
