"""Reconstruction: DC sums, de-interleaving, dequantising, inverse DCT, cropping.

Two forms of the transform give the same numbers: column expressions
(:func:`idct`), and a numpy pass over many blocks (:func:`reconstruct`), which
the decoder runs in its own batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr, fixed
from .scan import CHUNK, running_sums


def dc_integrate(units: DataFrame, units_per_segment: Column | int | None = None, *, size: int = CHUNK) -> DataFrame:
    """OP-49, OP-50: ``dc`` replaced by its running sum per component, restarting each segment.

    ``units``: image_id, component_idx, unit (of the component), dc.
    ``units_per_segment``: restart interval times the component's units in an MCU;
    none: the sum never restarts.  Sums of more than ``size`` units are made in two
    levels; an interval that is known to be shorter needs one.
    """
    keys = ["image_id", "component_idx", "segment_key"]
    keyed = units.withColumn("segment_key", F.lit(0).cast("bigint") if units_per_segment is None else expr.idiv(F.col("unit"), units_per_segment))
    if isinstance(units_per_segment, int) and units_per_segment <= size:
        upto = W.partitionBy(*keys).orderBy("unit").rowsBetween(W.unboundedPreceding, W.currentRow)
        return keyed.withColumn("dc", expr.wrap16(F.sum(F.col("dc").cast("bigint")).over(upto))).drop("segment_key")
    summed = running_sums(keyed, keys, "unit", {"dc": F.col("dc")}, inclusive=True, size=size)
    return summed.select(*[expr.wrap16(F.col("dc")).alias("dc") if c == "dc" else c for c in units.columns])


def unit_address(units: DataFrame) -> DataFrame:
    """OP-51: ``address`` in stream order of a component's ``i``-th unit.

    ``units``: i, units_of_component, units_in_mcu, first_in_mcu.
    """
    i, own = F.col("i"), F.col("units_of_component")
    return units.withColumn("address", expr.idiv(i, own) * F.col("units_in_mcu") + F.col("first_in_mcu") + i % own)


def mcu_layout(components: DataFrame) -> DataFrame:
    """Rows (image_id, scan_idx, k, component_idx, x_in, y_in, ss_x, ss_y) of the units of an MCU, in order.

    ``components``: image_id, scan_idx, sc, component_idx, ss_x, ss_y.
    """
    before = W.partitionBy("image_id", "scan_idx").orderBy("sc").rowsBetween(W.unboundedPreceding, -1)
    offset = components.withColumn("off", F.coalesce(F.sum(F.col("ss_x") * F.col("ss_y")).over(before), F.lit(0)))
    each = offset.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ss_x") * F.col("ss_y") - 1)))
    return each.select("image_id", "scan_idx", (F.col("off") + F.col("i")).alias("k"), "component_idx", (F.col("i") % F.col("ss_x")).alias("x_in"), expr.idiv(F.col("i"), F.col("ss_x")).alias("y_in"), "ss_x", "ss_y")


def deinterleave(units: DataFrame, layout: DataFrame, scans: DataFrame) -> DataFrame:
    """OP-52, OP-53: units (image_id, scan_idx, unit, ..) to component and block place, of all scans.

    ``scans``: image_id, scan_idx, num_mcus_x, units_in_mcu.
    """
    keys = ["image_id", "scan_idx"]
    # an MCU has ten units at most: a scan's layout is one small array, and the units join it once
    mcus = layout.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "component_idx", "x_in", "y_in", "ss_x", "ss_y"))).alias("layout"))
    facts = scans.select(*keys, "num_mcus_x", "units_in_mcu").join(mcus, keys)
    s = units.join(facts, keys).withColumns({"mcu": expr.idiv(F.col("unit"), F.col("units_in_mcu")), "at": F.get("layout", (F.col("unit") % F.col("units_in_mcu")).cast("int"))})
    rest = [c for c in units.columns if c not in ("image_id", "scan_idx", "unit")]
    return s.select(
        "image_id", "at.component_idx",
        (expr.idiv(F.col("mcu"), F.col("num_mcus_x")) * F.col("at.ss_y") + F.col("at.y_in")).alias("block_y"),
        (F.col("mcu") % F.col("num_mcus_x") * F.col("at.ss_x") + F.col("at.x_in")).alias("block_x"),
        *rest,
    )


def dequantize(blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """OP-54: blocks (.., coef) times the table (.., q) of the same ``keys``."""
    both = blocks.join(tables.select(*keys, "q"), keys)
    return both.select(*[c for c in blocks.columns if c != "coef"], expr.dequantize_array(F.col("coef"), F.col("q")).alias("coef"))


def idct(blocks: DataFrame) -> DataFrame:
    """OP-55 to OP-57: dequantised blocks (.., coef) to pixels (.., px)."""
    px = expr.to_pixels(expr.idct_2d("transform(coef, x -> cast(x as bigint))"))
    return blocks.select(*[c for c in blocks.columns if c != "coef"], px.alias("px"))


def crop(pixels: DataFrame) -> DataFrame:
    """OP-58: rows (x, y, width, height, ..) inside the component."""
    return pixels.where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))


def to_pixel_rows(blocks: DataFrame) -> DataFrame:
    """Pixel blocks to rows (image_id, component_idx, y, x, v); only where a query needs single pixels."""
    keep = [c for c in blocks.columns if c not in ("block_y", "block_x", "px")]
    p = blocks.select(*keep, "block_y", "block_x", F.posexplode("px").alias("i", "v"))
    return p.select(*keep, (F.col("block_y") * 8 + expr.idiv(F.col("i"), 8)).alias("y"), (F.col("block_x") * 8 + F.col("i") % 8).alias("x"), F.col("v").cast("int").alias("v"))


def _wrap(x: np.ndarray) -> np.ndarray:
    return ((x + 32768) & 65535) - 32768


def _transform(v: list[np.ndarray]) -> list[np.ndarray]:
    """The 1-D transform over arrays."""
    c4 = fixed.COS_1_4
    a, b = ((x * c4 + 4096) >> 13 for x in (v[3] + v[5], v[3] - v[5]))
    p, m = (v[0] + v[4]) * c4, (v[0] - v[4]) * c4
    q, r = v[2] * fixed.COS_1_8 + v[6] * fixed.SIN_1_8, v[2] * fixed.SIN_1_8 - v[6] * fixed.COS_1_8
    f, g = 4 * v[1], 4 * v[7]
    odd = [
        (f + a) * fixed.COS_1_16 + (g + b) * fixed.SIN_1_16,
        (f - a) * fixed.SIN_5_16 - (g - b) * fixed.COS_5_16,
        (f - a) * fixed.COS_5_16 + (g - b) * fixed.SIN_5_16,
        (f + a) * fixed.SIN_1_16 - (g + b) * fixed.COS_1_16,
    ]
    even = [p + q, m + r, m - r, p - q]
    low = [_wrap((e + o + 32768) >> 16) for e, o in zip(even, odd)]
    return low + [_wrap((e - o + 32768) >> 16) for e, o in zip(even[::-1], odd[::-1])]


def reconstruct(coef: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantised blocks [n, 64] and a table [64], or one for each block [n, 64], to pixels [n, 64]."""
    out = np.empty(coef.shape, np.int16)
    for lo in range(0, len(coef), 4096):  # parts that stay in the processor's cache
        # 16-bit coefficients times divisors of 8 bits stay within 32 bits
        x = _wrap(coef[lo : lo + 4096].astype(np.int32) * (q if q.ndim == 1 else q[lo : lo + 4096]).astype(np.int32)).reshape(-1, 8, 8)
        if max(int(x.max()), -int(x.min())) > 4000:  # else no sum of either pass leaves 32 bits
            x = x.astype(np.int64)
        x = np.stack(_transform([x[:, k, :] for k in range(8)]), axis=1)
        x = np.stack(_transform([x[:, :, k] for k in range(8)]), axis=2)
        out[lo : lo + 4096] = np.clip(_wrap(x + 128), 0, 255).reshape(-1, 64)
    return out
