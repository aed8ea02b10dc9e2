"""Binary columns as files, one a row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_OWN: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-lumiframe-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, once, and read back: for what a plan reads several times."""
    path = f"{scratch_folder(df.sparkSession)}/lumiframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: a path without one is on Spark's default file system, not on a local disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def write_files(rows: DataFrame, folder: str, *, name_col: str = "file", content_col: str = "content") -> DataFrame:
    """Writes ``folder/<name>`` for each row, from the executors; gives the other columns and the name.

    The folder must be one that all executors share.  A file is first written under
    another name, so that a task that runs twice leaves one whole file.
    """
    target = qualified(rows.sparkSession, folder)
    kept = [f for f in rows.schema.fields if f.name != content_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(target)
        at.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b.column(name_col).to_pylist(), b.column(content_col)):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with at.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                at.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept], names=[f.name for f in kept])

    return rows.mapInArrow(run, T.StructType(kept))
