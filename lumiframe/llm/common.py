"""Helpers shared by the operators: columns, cut lineage, text passes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: list[str] = []
_LEFT: set[str] = set()
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SLICE = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where the session leaves both unset *and* runs in local mode (tests) is a
    temporary folder made and used; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-lumiframe-"))
    return _OWN_DIR[0]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the actions inside, where rows are wide; None: as the session has it."""
    before = spark.conf.get(_BATCH_ROWS, "10000")
    if rows:
        spark.conf.set(_BATCH_ROWS, rows)
    try:
        yield
    finally:
        if rows:
            spark.conf.set(_BATCH_ROWS, before)


def materialize(df: DataFrame, name: str, *, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage durably (a lost executor costs nothing) and gives Catalyst
    the true size, so that it broadcasts a side only if it is really small.
    ``batch_rows``: rows of an Arrow batch in this job, for wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumiframe/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    _LEFT.add(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, through the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _LEFT.discard(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing that is still to run reads them.

    Other frames, and None, are left alone.  Deletion goes through the file system
    of the path, wherever it is.
    """
    for df in tables:
        path = _WRITTEN.pop(df, None) if df is not None else None
        if path:
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that :func:`materialize` wrote inside it.

    What is to stay must be written elsewhere by then: a lazy frame that an operator
    returned inside cannot be read outside.
    """
    before = set(_LEFT)
    try:
        yield
    finally:
        for path in _LEFT - before:
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_key(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, written with a long that is different in every row, and that column's name."""
    key = fresh(df, "_row")
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), name), key


def bounded_by_hash(df: DataFrame, key: str | list[str], bound: int, total: int) -> DataFrame:
    """About ``bound`` of the ``total`` rows, the same ones in every run, without a sort."""
    if total <= bound:
        return df
    keys = [key] if isinstance(key, str) else key
    return df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < int(bound / total * (1 << 30)))


def append_columns(
    df: DataFrame,
    source: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """All columns of ``df`` and ``fields``, computed batch by batch from ``source``.

    ``make`` runs once a task and gives the function from an Arrow array to the
    new arrays.  Nothing but one batch is held.  A column of ``df`` that has the
    name of a new one gives way to it.
    """
    taken = {f.name.lower() for f in fields}
    df = df.select(*[f"`{c}`" for c in df.columns if c == source or c.lower() not in taken])
    schema = T.StructType([*df.schema.fields, *fields])
    names, at = [f.name for f in schema.fields], df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):  # Python objects of one slice at a time
                part = b.slice(lo, _SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, *f(part.column(at))], names=names)

    return df.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies; ``LUMIFRAME_TOKENIZERS`` may name another folder."""
    own = os.environ.get("LUMIFRAME_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)
