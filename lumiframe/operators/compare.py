"""Comparison of decodes, and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIXEL = ["image_id", "component_idx", "y", "x"]


def mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """OP-63: (image_id, component_idx, mse) over pixels that both have; sums stay whole numbers."""
    d = F.col("v").cast("bigint") - F.col("w").cast("bigint")
    both = a.select(*_PIXEL, "v").join(b.select(*_PIXEL, F.col("v").alias("w")), _PIXEL)
    return both.groupBy("image_id", "component_idx").agg((F.sum(d * d) / F.count("*")).alias("mse"))


def block_mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """OP-63 over pixel blocks (image_id, component_idx, block_y, block_x, px, width, height): blocks meet blocks.

    Samples in the padding do not count, nor those that one side lacks.
    """
    block = ["image_id", "component_idx", "block_y", "block_x"]
    x = a.select(*block, F.col("px").alias("p"), F.col("width").alias("w"), F.col("height").alias("h"))
    both = x.join(b.select(*block, F.col("px").alias("q"), "width", "height"), block)
    columns, lines = (F.expr(f"cast(greatest(0, least(8, {mine} - {at} * 8, {other} - {at} * 8)) as int)") for at, mine, other in (("block_x", "w", "width"), ("block_y", "h", "height")))
    squares = "zip_with(p, q, (s, t) -> cast(s - t as bigint) * (s - t))"
    total = F.expr(f"aggregate(if(columns * lines = 64, {squares}, filter({squares}, (d, i) -> i % 8 < columns and i div 8 < lines)), 0L, (n, d) -> n + d)")
    each = both.withColumns({"columns": columns, "lines": lines}).select("image_id", "component_idx", total.alias("squares"), (F.col("columns") * F.col("lines")).alias("n"))
    return each.where("n > 0").groupBy("image_id", "component_idx").agg((F.sum("squares") / F.sum("n")).alias("mse"))


def structure_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """OP-64: components of which sizes or sampling differ, or that one side lacks."""
    own = ["width", "height", "ss_x", "ss_y"]
    x = a.select("image_id", "component_idx", F.struct(*own).alias("a"))
    y = b.select("image_id", "component_idx", F.struct(*own).alias("b"))
    return x.join(y, ["image_id", "component_idx"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def latency_stats(samples: DataFrame, keys: list[str], milliseconds: str) -> DataFrame:
    """OP-66: count, mean and largest latency, and throughput per second, by ``keys``."""
    ms = F.col(milliseconds)
    return samples.groupBy(*keys).agg(F.count(ms).alias("n"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"), (F.count(ms) / (F.sum(ms) / 1000)).alias("per_second"))
