"""Dimension lookups and header predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr, fixed


def _dimension(df: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of fixed rows; broadcast, since its size is known."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, ddl))


def marker_names(codes: DataFrame) -> DataFrame:
    """OP-06: ``codes`` (code, ...) with ``name``."""
    names = _dimension(codes, sorted(fixed.MARKER_NAMES.items()), "code int, name string")
    return codes.join(names, "code", "left").withColumn("name", F.coalesce("name", F.lit(fixed.UNKNOWN_MARKER))).select(*codes.columns, "name")


def with_status_text(rows: DataFrame) -> DataFrame:
    """OP-20: ``rows`` (status, ...) with ``message``."""
    return rows.withColumn("message", expr.status_text(F.col("status")))


def subsampling_factors(named: DataFrame) -> DataFrame:
    """OP-65: ``named`` (css, ...) with the luma factors; unknown names give 0."""
    known = _dimension(named, [(n, x, y) for n, (x, y) in fixed.SUBSAMPLING.items()], "css string, luma_x int, luma_y int")
    return named.join(known, "css", "left").fillna(0, ["luma_x", "luma_y"])


def with_is_444(info: DataFrame) -> DataFrame:
    """OP-18: ``info`` (ss_x, ss_y, num_components) with ``is_444``."""
    return info.withColumn("is_444", expr.is_444(F.col("ss_x"), F.col("ss_y"), F.col("num_components")))


def same_subsampling(a: DataFrame, b: DataFrame) -> DataFrame:
    """OP-19: (image_id, same): equality of the factors over all slots."""
    x, y = a.select("image_id", "ss_x", "ss_y"), b.select("image_id", F.col("ss_x").alias("tx"), F.col("ss_y").alias("ty"))
    return x.join(y, "image_id").select("image_id", ((F.col("ss_x") == F.col("tx")) & (F.col("ss_y") == F.col("ty"))).alias("same"))


def component_sizes(components: DataFrame, frames: DataFrame) -> DataFrame:
    """OP-07, OP-08: components (ss_x, ss_y) of frames (width, height), with the maxima and their sizes."""
    top = components.groupBy("image_id").agg(F.max("ss_x").alias("ss_max_x"), F.max("ss_y").alias("ss_max_y"))
    both = components.join(top, "image_id").join(frames.select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), "image_id")
    return both.select(
        "image_id", "component_idx", "ss_max_x", "ss_max_y",
        expr.component_size(F.col("w"), F.col("ss_x"), F.col("ss_max_x")).alias("width"),
        expr.component_size(F.col("h"), F.col("ss_y"), F.col("ss_max_y")).alias("height"),
    )


def mcu_geometry(components: DataFrame, frames: DataFrame) -> DataFrame:
    """OP-14: (image_id, num_mcus_x, num_mcus_y, units_in_mcu) of one interleaved scan of all components."""
    each = components.groupBy("image_id").agg(F.max("ss_x").alias("mx"), F.max("ss_y").alias("my"), F.sum(F.col("ss_x") * F.col("ss_y")).alias("u"), F.count("*").alias("n"), F.max("width").alias("cw"), F.max("height").alias("ch"))
    both = each.join(frames.select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), "image_id")
    one = F.col("n") == 1
    return both.select(
        "image_id",
        expr.ceil_div(F.col("w"), F.when(one, 8).otherwise(F.col("mx") * 8)).alias("num_mcus_x"),
        expr.ceil_div(F.col("h"), F.when(one, 8).otherwise(F.col("my") * 8)).alias("num_mcus_y"),
        F.when(one, 1).otherwise(F.col("u")).cast("bigint").alias("units_in_mcu"),
    )


def missing_components(components: DataFrame, scan_components: DataFrame) -> DataFrame:
    """OP-17: components that no scan holds."""
    return components.join(scan_components.select("image_id", "component_idx"), ["image_id", "component_idx"], "left_anti")


def decode_cost(parsed: DataFrame) -> DataFrame:
    """OP-72: (image_id, units, samples, entropy_bytes) that decoding would handle; nothing is decoded."""
    s = parsed.select("image_id", F.explode("scans").alias("s"))
    total = lambda f: F.aggregate("s.components", F.lit(0).cast("long"), lambda a, c: a + f(c))
    samples = total(lambda c: c["data_x"].cast("long") * c["data_y"])
    per = s.select("image_id", samples.alias("n"), (F.col("s.end") - F.col("s.begin")).alias("b"))
    return per.groupBy("image_id").agg(F.sum((F.col("n") / 64).cast("long")).alias("units"), F.sum("n").alias("samples"), F.sum("b").alias("entropy_bytes"))
