"""Structured Streaming over arriving images: the batch operators without shuffles run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import header, images, ranged


def stream_frames(spark: SparkSession, path: str, *, by_ranges: bool = False) -> DataFrame:
    """Frames of files as they arrive under ``path``; ``by_ranges``: the pixels are not read (:mod:`..sources.ranged`)."""
    arriving = images.stream_images(spark, path)
    return header.frames(ranged.headers(arriving, frame_only=True) if by_ranges else header.headers(arriving))


def arrivals_by_status(arrived: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Images by status and window of their file's time; ``arrived``: modificationTime, status."""
    return arrived.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "status").agg(F.count("*").alias("n"))
