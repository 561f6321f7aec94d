"""Object listings with continuation: a stream that lists what is new, and the full scans as views of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

LISTING = "key string, last_modified timestamp, size long"


def _objects(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(time in nanoseconds, key, size) of the files below ``path``, in that order; keys are relative to it."""
    system, root = fs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", path))
    root = root.rstrip("/")
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((i.mtime_ns or 0, i.path[len(root) + 1 :], i.size or 0) for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))


def _row(found: tuple[int, str, int]) -> tuple:
    return found[1], datetime.fromtimestamp(found[0] / 1e9, timezone.utc), found[2]


class _Page(InputPartition):
    pass


class _Whole(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        return [_Page(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from map(_row, _objects(self.path, self.suffix))


class _New(SimpleDataSourceStreamReader):
    """Offsets are continuation tokens: the time and the key of the last object that was listed."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.page = options["path"], options.get("suffix", ""), int(options.get("page", 1000))

    def initialOffset(self) -> dict:
        return {"time": -1, "key": ""}

    def _after(self, start: dict) -> list[tuple[int, str, int]]:
        return [o for o in _objects(self.path, self.suffix) if o[:2] > (start["time"], start["key"])]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = self._after(start)[: self.page]
        return iter(list(map(_row, page))), {"time": page[-1][0], "key": page[-1][1]} if page else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (_row(o) for o in self._after(start) if o[:2] <= (end["time"], end["key"]))


class Listing(DataSource):
    """Format "listing": (key, last_modified, size) of the objects below a path, contents unread.

    Options: path; suffix, that keys end in; page, the most objects that a batch of a stream lists. As a stream, each
    batch goes on behind the continuation token of the one before, also over restarts: an object is listed once, again only
    after it has been rewritten. An object that gets an older time than the token, as a copy with its times kept may, is not seen by
    a stream; the batch form lists it.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: object) -> DataSourceReader:
        return _Whole(self.options)

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _New(self.options)


def read_listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """All objects below ``path`` as they are now."""
    spark.dataSource.register(Listing)
    return spark.read.format("listing").option("suffix", suffix).load(path)


def stream_listing(spark: SparkSession, path: str, suffix: str = "", page: int = 1000) -> DataFrame:
    """Objects below ``path`` as they come, each once."""
    spark.dataSource.register(Listing)
    return spark.readStream.format("listing").options(suffix=suffix, page=page).load(path)


def newest_objects(listing: DataFrame, k: int) -> DataFrame:
    """The ``k`` objects changed last, ties by key."""
    return listing.orderBy(F.col("last_modified").desc(), "key").limit(k)
