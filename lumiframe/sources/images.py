"""Image collections as DataFrames of (image_id, length, content)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Spark's ``binaryFile`` gives; stated, so that streams need no inference.
BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


@contextmanager
def image_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside; the session's own setting afterwards.

    A batch never exceeds its partition, and file partitions are of 128 MB by
    default (``spark.sql.files.maxPartitionBytes``); this is for sources whose
    partitions are larger, or for small workers.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_images(spark: SparkSession, path: str | list[str], *, pattern: str = "*.[jJ][pP]*[gG]") -> DataFrame:
    """OP-01: all JPEG files under ``path``; filters on ``length`` and the file's time reach the scan."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("image_id"), "length", "content", "modificationTime")


def stream_images(spark: SparkSession, path: str, *, pattern: str = "*.[jJ][pP]*[gG]") -> DataFrame:
    """The same of files as they arrive."""
    found = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("image_id"), "length", "content", "modificationTime")


def from_table(df: DataFrame, id_col: str, binary_col: str) -> DataFrame:
    """Images that a table holds in a binary column."""
    return df.select(F.col(id_col).cast("string").alias("image_id"), F.length(binary_col).cast("long").alias("length"), F.col(binary_col).alias("content"))
