"""Two-phase publishing: tasks write files, a manifest makes them visible. A data source for batches and streams."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a file that are held before they are written.
ROWS = 1 << 16


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written: its name, none without rows, its rows and greatest index."""

    file: str | None
    rows: int
    index: int | None


@dataclass
class OneFile(InputPartition):
    file: str


class _Place:
    """A folder of published data: files in data/, and manifests that say which of them count."""

    def __init__(self, options: dict):
        self.path, self.column = options["path"], options.get("indexcolumn") or options.get("indexColumn")

    def open(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", self.path))
        return system, root.rstrip("/")

    def manifests(self) -> dict[str, dict]:
        """All that is committed, by name."""
        system, root = self.open()
        found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        out = {}
        for info in sorted(found, key=lambda i: i.path):
            if info.path.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    out[info.base_name] = json.loads(f.read())
        return out

    def commit(self, name: str, messages: list[Written | None], **more: object) -> None:
        """Phase two. A name that is committed already stays as it is, and the files of this attempt go."""
        system, root = self.open()
        at, known = f"{root}/manifests/{name}.json", [m for m in messages if m is not None and m.file]
        if system.get_file_info(at).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        indexes = [m.index for m in known if m.index is not None]
        content = {**more, "files": [m.file for m in known], "rows": sum(m.rows for m in known), "committed_index": max(indexes, default=None)}
        system.create_dir(f"{root}/manifests", recursive=True)
        temporary = f"{at}.{uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps(content).encode())
        system.move(temporary, at)  # visible as a whole or not at all

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self.open()
        for m in messages:
            if m is not None and m.file and system.get_file_info(f"{root}/data/{m.file}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/data/{m.file}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Phase one: the rows of a task as a file under a name that no other attempt has."""
        system, root = self.open()
        file, rows, index, writer = f"{uuid4().hex}.parquet", 0, None, None
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if writer is None:
                    system.create_dir(f"{root}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/data/{file}", batch.schema, filesystem=system)
                writer.write_batch(batch, row_group_size=ROWS)
                rows += len(batch)
                if self.column:
                    here = [x for x in (pa.compute.max(batch.column(self.column)).as_py(), index) if x is not None]
                    index = max(here, default=None)
        finally:
            if writer is not None:
                writer.close()
        return Written(file if writer is not None else None, rows, index)


class _Batches(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.place, self.name = _Place(options), options.get("name") or uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.place.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.place.commit(self.name, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.place.abort(messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.place, self.query = _Place(options), options.get("name", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.place.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.place.commit(f"{self.query}-{batchId:012d}", messages, batch=batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.place.abort(messages)


class _Committed(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.place, self.names = _Place(options), schema.names

    def partitions(self) -> list[OneFile]:
        return [OneFile(f) for m in self.place.manifests().values() for f in m["files"]]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is committed
            return
        system, root = self.place.open()
        with system.open_input_file(f"{root}/data/{partition.file}") as f:
            yield from pq.ParquetFile(f).iter_batches(ROWS, columns=self.names)


class Published(DataSource):
    """Format "published": rows that are there once, whatever is repeated or lost.

    Options: path, a folder that all machines reach; indexColumn, whose greatest value a manifest records as its committed
    index; name, of a batch write or of a stream's query. A task writes its rows to a file under a new name and reports
    it. Only when all have, the driver writes a manifest that names the files; a second attempt of a task, a killed job or
    an aborted batch leaves files that no manifest names, and nobody reads them. A name (for streams: query and batch) is
    committed once: a stream's batch that runs again after a crash, or a batch write repeated under its name, changes
    nothing. Readers give the schema and see what is committed when they plan.
    """

    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        raise ValueError("give the schema: spark.read.format('published').schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Committed(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("published rows stay: write in append mode")
        return _Batches(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options)


def read_published(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a published folder that are committed."""
    spark.dataSource.register(Published)
    return spark.read.format("published").schema(schema).load(path)


def write_published(rows: DataFrame, path: str, index_column: str | None = None, name: str | None = None) -> None:
    """Publish ``rows`` as a whole; under a ``name`` that is there already, nothing happens."""
    rows.sparkSession.dataSource.register(Published)
    options = {"indexColumn": index_column, "name": name}
    rows.write.format("published").options(**{k: v for k, v in options.items() if v}).mode("append").save(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(name, batch, rows, committed_index, files) of each commit; their number, and not that of rows, counts."""
    known = _Place({"path": path}).manifests()
    rows = [(n.removesuffix(".json"), m.get("batch"), m["rows"], m["committed_index"], m["files"]) for n, m in known.items()]
    return spark.createDataFrame(rows, "name string, batch long, rows long, committed_index long, files array<string>")


def resume_after(spark: SparkSession, path: str) -> int:
    """The greatest index that any commit holds; -1 before the first."""
    found = [m["committed_index"] for m in _Place({"path": path}).manifests().values() if m["committed_index"] is not None]
    return max(found, default=-1)
