"""Intermediate results in the folder that all machines share, and the size of what Spark hands to Python."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` where it is not set yet.

    Only a session on one machine without that setting (tests) gets a temporary folder; on a cluster no folder is known to
    be shared without it.
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


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder, without its lineage; it survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, written to the shared folder as compressed Parquet and read from there; deleted at the end, so for what is written anew within."""
    spark, folder = df.sparkSession, session_folder(df.sparkSession, "kept")
    df.write.parquet(folder)
    try:
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def session_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the session's JVM ends."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid4()}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let this session hand at most about ``most`` bytes (or one row) to Python at a time, unless it is set to less.

    Both the executor's JVM and its Python workers hold a batch, and the JVM keeps the memory: at Spark's 64 MB, batches of
    long texts take several hundred MB of an executor. The setting stays, as DataFrames run later than they are made.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    """A size as Spark writes it: bytes, or a number of k, m or g."""
    number, unit = size.lower().rstrip("b"), 1
    for k, u in enumerate("kmgt", 1):
        if number.endswith(u):
            number, unit = number[:-1], 1 << 10 * k
    return int(number) * unit
