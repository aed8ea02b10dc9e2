"""Byte destuffing and restart segmentation over a byte table.

``bytes``: image_id, scan_idx, pos, b.  Scans are cut into chunks of positions
(:mod:`.scan`): no task holds more than a chunk, what a chunk must know of those
before it (the last byte, the segment that is open, counts) is carried over by one row
a chunk.  For whole files use :mod:`.decode`, which does the same within a task, or
:mod:`.ranges` for one file over many tasks; these forms are for queries over bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.fixed import SUBSEQUENCE_BYTES
from .scan import CHUNK, running_sums, with_chunk

_SCAN = ["image_id", "scan_idx"]


def byte_flags(data: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """OP-24, OP-25: with ``is_data``, ``value`` (FF 00 is one FF) and ``is_restart`` (second byte of RSTn)."""
    cut = with_chunk(data, "pos", size)
    last = cut.groupBy(*_SCAN, "chunk").agg(F.max_by("b", "pos").alias("last"))
    carried = last.select(*_SCAN, "chunk", F.lag("last").over(W.partitionBy(*_SCAN).orderBy("chunk")).alias("carried"))
    inside = F.lag("b").over(W.partitionBy(*_SCAN, "chunk").orderBy("pos"))
    both = cut.withColumn("prev", inside).join(carried, [*_SCAN, "chunk"])
    after = F.coalesce("prev", "carried", F.lit(-1)) == 255
    return both.select(
        *data.columns,
        F.when(after, F.col("b") == 0).otherwise(F.col("b") != 255).alias("is_data"),
        F.when(after, 255).otherwise(F.col("b")).cast("int").alias("value"),
        (after & F.col("b").between(208, 215)).alias("is_restart"),
    )


def segment_index(flags: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """OP-26: with ``segment_idx``, the number of restarts before the byte."""
    counted = running_sums(flags, _SCAN, "pos", {"segment_idx": F.col("is_restart")}, size=size)
    return counted.withColumn("segment_idx", F.col("segment_idx").cast("int"))


def destuff_offset(indexed: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """OP-27: with ``offset``, the number of data bytes before in the segment.

    Only the segment that a chunk begins in has bytes in chunks before; each of those
    ends in it, so what they hold of it is the sum over chunks with that last segment.
    """
    cut = with_chunk(indexed, "pos", size)
    zero = F.lit(0).cast("bigint")
    held = cut.groupBy(*_SCAN, "chunk", "segment_idx").agg(F.sum(F.col("is_data").cast("bigint")).alias("n"))
    ends = held.groupBy(*_SCAN, "chunk").agg(F.min("segment_idx").alias("first"), F.max("segment_idx").alias("last"), F.max_by("n", "segment_idx").alias("tail"))
    upto = W.partitionBy(*_SCAN, "last").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    open_ = F.lag(F.struct("last", "open")).over(W.partitionBy(*_SCAN).orderBy("chunk"))
    carried = ends.withColumn("open", F.sum("tail").over(upto)).withColumn("before", open_)
    carried = carried.select(*_SCAN, "chunk", "first", F.when(F.col("before.last") == F.col("first"), F.col("before.open")).otherwise(zero).alias("carried"))
    inside = W.partitionBy(*_SCAN, "chunk", "segment_idx").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    both = cut.withColumn("offset", F.coalesce(F.sum(F.col("is_data").cast("bigint")).over(inside), zero)).join(carried, [*_SCAN, "chunk"])
    return both.select(*indexed.columns, (F.col("offset") + F.when(F.col("segment_idx") == F.col("first"), F.col("carried")).otherwise(zero)).alias("offset"))


def segments(indexed: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """OP-22, OP-23: (image_id, scan_idx, segment_idx, num_bytes, subseq_count, subseq_offset)."""
    n = indexed.groupBy(*_SCAN, "segment_idx").agg(F.sum(F.col("is_data").cast("bigint")).alias("num_bytes"))
    counted = n.withColumn("subseq_count", expr.ceil_div(F.col("num_bytes"), SUBSEQUENCE_BYTES).cast("bigint"))
    return running_sums(counted, _SCAN, "segment_idx", {"subseq_offset": F.col("subseq_count")}, size=size)


def destuffed_bytes(placed: DataFrame, segs: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """OP-28: data bytes with ``dest``, their place when each segment starts at a whole subsequence.

    Bytes meet their segment by (segment, chunk), so that a long one is no hot key.
    """
    kept = with_chunk(placed.where("is_data"), "pos", size)
    spans = kept.select(*_SCAN, "segment_idx", "chunk").distinct()
    own = spans.join(segs.select(*_SCAN, "segment_idx", "subseq_offset"), [*_SCAN, "segment_idx"])
    both = kept.join(own, [*_SCAN, "segment_idx", "chunk"])
    return both.select(*_SCAN, "segment_idx", "offset", (F.col("subseq_offset") * SUBSEQUENCE_BYTES + F.col("offset")).alias("dest"), F.col("value").alias("b"))


def subsequence_map(dest: DataFrame) -> DataFrame:
    """OP-29, OP-30: (image_id, scan_idx, subseq_idx, segment_idx) of each subsequence head.

    Segments start at whole subsequences, so a head's place alone is its number.
    """
    heads = dest.where(F.col("offset") % SUBSEQUENCE_BYTES == 0)
    return heads.select(*_SCAN, expr.idiv(F.col("dest"), SUBSEQUENCE_BYTES).cast("bigint").alias("subseq_idx"), "segment_idx")


def padded_segments(dest: DataFrame) -> DataFrame:
    """OP-31: (image_id, scan_idx, segment_idx, data): bytes in order, zeros up to whole subsequences."""
    text = dest.groupBy(*_SCAN, "segment_idx").agg(F.sort_array(F.collect_list(F.struct("offset", "b"))).alias("s"))
    raw = F.unhex(F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x["b"]), 2, "0")), ""))
    size = expr.ceil_div(F.size("s"), SUBSEQUENCE_BYTES) * SUBSEQUENCE_BYTES
    return text.select(*_SCAN, "segment_idx", F.rpad(raw, size.cast("int"), F.lit(b"\x00")).alias("data"))


def symbol_offsets(subsequences: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """OP-43: (.., subseq, n) with ``position``, the symbols of the segment before."""
    return running_sums(subsequences, [*_SCAN, "segment_idx"], "subseq", {"position": F.col("n")}, size=size)
