"""Binary columns as files with a commit: a job's files appear together, or not at all.

``df.write.format("binary_files").mode("append").save(folder)`` of (name, content).
Tasks write below a hidden folder of the job, each attempt in a folder of its own; the
driver then moves the folders of the attempts that Spark counted to ``folder/part-N``,
one rename each, and drops the others.  A job that fails leaves nothing; a task that
ran twice leaves one file of each name.  On object stores a move is a copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.paths import resolve
from .files import qualified


@dataclass
class Written(WriterCommitMessage):
    """The folder of one attempt, and how many files it holds."""

    part: int
    folder: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].rstrip("/")
        self.name, self.content = options.get("name", "name"), options.get("content", "content")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _staging(self) -> str:
        parent, _, name = self.folder.rpartition("/")
        return f"{parent}/.{name}.{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        own = f"{self._staging()}/{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        at, inside = resolve(own)
        at.create_dir(inside, recursive=True)
        n = 0
        for b in batches:
            for name, content in zip(b.column(b.schema.get_field_index(self.name)).to_pylist(), b.column(b.schema.get_field_index(self.content))):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"{name!r} is no file name")
                with at.open_output_stream(f"{inside}/{name}") as f:
                    f.write(content.as_buffer() or b"")
                n += 1
        return Written(task.partitionId(), own, n)

    def commit(self, messages: list[Written | None]) -> None:
        at, target = resolve(self.folder)
        if self.overwrite:
            from pyarrow import fs

            if at.get_file_info(target).type == fs.FileType.Directory:
                at.delete_dir(target)
        at.create_dir(target, recursive=True)
        for m in messages:
            if m is not None and m.files:
                at.move(resolve(m.folder)[1], f"{target}/part-{m.part:05d}-{self.job[:12]}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        at, staging = resolve(self._staging())
        if at.get_file_info(staging).type == fs.FileType.Directory:
            at.delete_dir(staging)


class BinaryFiles(DataSource):
    """Options ``name`` and ``content``: the columns that hold them."""

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> StructType:
        return StructType.fromDDL("name string, content binary")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        names = [self.options.get("name", "name"), self.options.get("content", "content")]
        if [schema[n].dataType.simpleString() if n in schema.names else None for n in names] != ["string", "binary"]:
            raise ValueError("a string column of names and a binary column of contents are needed")
        return FilesWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinaryFiles)


def save_files(rows: DataFrame, folder: str, *, name_col: str = "name", content_col: str = "content", mode: str = "append") -> None:
    """Writes each row's content as a file of its name below ``folder``, all or nothing."""
    spark = rows.sparkSession
    register(spark)
    rows.select(name_col, content_col).write.format("binary_files").option("name", name_col).option("content", content_col).mode(mode).save(qualified(spark, folder))
