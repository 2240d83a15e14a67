"""Delivery of rows to a folder, each batch once: a Python data source whose writer commits.

    rows.write.format("outbox").option("path", folder).option("batch", 7).mode("append").save()

A task writes its rows as one file of JSON lines that nobody reads yet, and tells the driver its name. When all tasks are done, the commit writes the
batch's list of files; only listed files count. A batch that is already listed is not delivered again: its new files are removed. A failed write
leaves no list, and its files are removed. Folders are any that pyarrow's file systems open, and shared by the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int


class OutboxWriter(DataSourceWriter):
    def __init__(self, folder: str, batch: int):
        self.folder, self.batch = folder.rstrip("/"), batch

    def write(self, rows: Iterator[Row]) -> Staged:
        files, root = opened(self.folder)
        name, n = f"{self.batch}-{uuid.uuid4().hex}.jsonl", 0
        files.create_dir(f"{root}/rows", recursive=True)
        with files.open_output_stream(f"{root}/rows/{name}") as out:
            for row in rows:
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
                n += 1
        return Staged(name, n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.folder)
        files.create_dir(f"{root}/batches", recursive=True)
        done = [m for m in messages if m is not None]
        if self._listed():
            self._remove(done)
            return
        new = f"{root}/batches/.{self.batch}-{uuid.uuid4().hex}"
        with files.open_output_stream(new) as out:
            out.write(json.dumps({"files": [m.name for m in done if m.rows], "rows": sum(m.rows for m in done)}).encode())
        files.move(new, f"{root}/batches/{self.batch}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        self._remove([m for m in messages if m is not None])

    def _listed(self) -> bool:
        from pyarrow import fs

        files, root = opened(self.folder)
        return files.get_file_info(f"{root}/batches/{self.batch}.json").type != fs.FileType.NotFound

    def _remove(self, messages: list[Staged]) -> None:
        files, root = opened(self.folder)
        for m in messages:
            files.delete_file(f"{root}/rows/{m.name}")


class OutboxSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        if overwrite:
            raise ValueError("an outbox is only appended to")
        return OutboxWriter(self.options["path"], int(self.options["batch"]))


def deliver(rows: DataFrame, folder: str, batch: int) -> None:
    """Deliver a batch; again, it changes nothing."""
    rows.sparkSession.dataSource.register(OutboxSink)
    rows.write.format("outbox").option("path", folder).option("batch", batch).mode("append").save()


def delivered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The delivered rows, with their batch."""
    lists = spark.read.schema("files array<string>").json(f"{folder.rstrip('/')}/batches/*.json")
    names = [f"{folder.rstrip('/')}/rows/{r.name}" for r in lists.selectExpr("explode(files) AS name").collect()]  # a name for each writing task
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
