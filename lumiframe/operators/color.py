"""Colour: chroma upsampling and YCbCr to RGB."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import expr, fixed
from .decode import Step, image_planes, runs


def gray_to_rgb(luma: DataFrame) -> DataFrame:
    """OP-60: luma pixels (image_id, y, x, v) to r = g = b."""
    return luma.select("image_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"])


def convertible(components: DataFrame) -> DataFrame:
    """OP-62's guard: (image_id, num_components, ok).

    One component; or three, luma not sampled below the chroma, both chroma alike.
    """
    at = lambda k, f: F.max(F.when(F.col("component_idx") == k, F.col(f)))
    s = components.groupBy("image_id").agg(F.count("*").alias("num_components"), *[at(k, f).alias(f"{f}{k}") for k in range(3) for f in ("ss_x", "ss_y")])
    alike = (F.col("ss_x1") == F.col("ss_x2")) & (F.col("ss_y1") == F.col("ss_y2"))
    coarse = (F.col("ss_x0") < F.col("ss_x1")) | (F.col("ss_y0") < F.col("ss_y1"))
    return s.select("image_id", "num_components", ((F.col("num_components") == 1) | ((F.col("num_components") == 3) & F.coalesce(alike & ~coarse, F.lit(False)))).alias("ok"))


def _source(at: str, chroma: str, luma: str) -> str:
    """SQL of the chroma sample of a luma sample, along one axis; divisions of whole numbers."""
    return f"(({at}) * {chroma} div {luma})"


def upsample(blocks: DataFrame, factors: DataFrame) -> DataFrame:
    """OP-61: (image_id, block_y, block_x, samples): luma blocks with the nearest chroma samples.

    ``blocks``: image_id, component_idx (0, 1, 2), block_y, block_x, px, width, height.
    ``factors``: image_id, luma_x, luma_y, chroma_x, chroma_y.  ``samples`` are (y, x,
    cy, cb, cr) inside the image.  Blocks meet blocks; positions are worked out in
    arrays, so no pixel is a row of a shuffle.  A luma block whose samples lie in
    several chroma blocks (up to four, where one factor is no multiple of the other)
    gives a row for each.
    """
    y, x = "block_y * 8 + i div 8", "block_x * 8 + i % 8"
    by, bx = _source(y, "chroma_y", "luma_y") + " div 8", _source(x, "chroma_x", "luma_x") + " div 8"
    luma = blocks.where("component_idx = 0").join(factors, "image_id").select(
        "image_id", "block_y", "block_x", "px", "width", "height", "luma_x", "luma_y", "chroma_x", "chroma_y",
        F.explode(F.expr(f"array_distinct(transform(array(0, 7, 56, 63), i -> struct(cast({by} as bigint) as y, cast({bx} as bigint) as x)))")).alias("of"),
    )
    own = blocks.where("component_idx in (1, 2)").groupBy("image_id", F.col("block_y").cast("bigint").alias("chroma_block_y"), F.col("block_x").cast("bigint").alias("chroma_block_x")).agg(
        F.max(F.when(F.col("component_idx") == 1, F.col("px"))).alias("cb"), F.max(F.when(F.col("component_idx") == 2, F.col("px"))).alias("cr")
    )
    own = own.where("cb is not null and cr is not null")
    both = luma.withColumns({"chroma_block_y": F.col("of.y"), "chroma_block_x": F.col("of.x")}).join(own, ["image_id", "chroma_block_y", "chroma_block_x"])
    here = f"filter(sequence(0, 63), i -> {y} < height and {x} < width and {by} = chroma_block_y and {bx} = chroma_block_x)"
    place = f"cast({_source(y, 'chroma_y', 'luma_y')} % 8 * 8 + {_source(x, 'chroma_x', 'luma_x')} % 8 as int)"
    samples = f"transform({here}, i -> struct(cast({y} as bigint) as y, cast({x} as bigint) as x, px[i] as cy, cb[{place}] as cb, cr[{place}] as cr))"
    return both.select("image_id", "block_y", "block_x", F.expr(samples).alias("samples"))


def to_rgb(upsampled: DataFrame) -> DataFrame:
    """OP-62: (image_id, y, x, r, g, b)."""
    each = upsampled.select("image_id", F.explode("samples").alias("s"))
    r, g, b = expr.ycbcr_to_rgb(F.col("s.cy"), F.col("s.cb"), F.col("s.cr"))
    return each.select("image_id", "s.y", "s.x", r.alias("r"), g.alias("g"), b.alias("b"))


RGB_IMAGES = "image_id string, status string, width int, height int, num_components int, rgb binary"


_SIGNED = np.arange(256) - 128.0
#: What chroma samples add to red and blue, rounded: luma is whole and no sum is a tie.  Green has two terms and is summed before it is rounded.
_RED, _BLUE = (np.floor(f * _SIGNED + 0.5).astype(np.int16) for f in (1.402, 1.772))
_GREEN_CB, _GREEN_CR = 0.344136 * _SIGNED, 0.714136 * _SIGNED


def _rgb(rows: list[dict]) -> dict:
    """The planes of one image as interleaved RGB; what cannot be converted gets a status and no bytes.

    A luma sample at x has the chroma sample at ``x * (chroma factor) div (luma factor)``, whatever the
    sizes that the planes were rounded up to.
    """
    rows = sorted(rows, key=lambda r: r["component_idx"])
    y, n = rows[0], len(rows)
    out = {"image_id": y["image_id"], "status": fixed.SUCCESS, "width": y["width"], "height": y["height"], "num_components": n, "rgb": None}
    p = [np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in rows]
    if n == 1:
        out["rgb"] = np.repeat(p[0][:, :, None], 3, axis=2).tobytes()
    elif n == 3 and all(rows[1][f] == rows[2][f] <= y[f] for f in ("ss_y", "ss_x")):
        at = [np.arange(p[0].shape[a]) * rows[1][f] // y[f] for a, f in enumerate(("ss_y", "ss_x"))]
        cb, cr = (c[np.ix_(*at)] for c in p[1:])
        luma, rgb = p[0].astype(np.int16), np.empty((*p[0].shape, 3), np.uint8)
        rgb[:, :, 0], rgb[:, :, 2] = np.clip(luma + _RED[cr], 0, 255), np.clip(luma + _BLUE[cb], 0, 255)
        rgb[:, :, 1] = np.clip(np.floor(p[0] - _GREEN_CB[cb] - _GREEN_CR[cr] + 0.5), 0, 255)
        out["rgb"] = rgb.tobytes()
    else:
        out["status"] = fixed.NOT_SUPPORTED
    return out


def rgb_step() -> Step:
    """Batches of planes, an image's one after another, to batches of RGB images."""
    arrow = to_arrow_schema(StructType.fromDDL(RGB_IMAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            yield pa.RecordBatch.from_pylist([_rgb(t.to_pylist())], schema=arrow)

    return run


def rgb_images(blocks: DataFrame) -> DataFrame:
    """Whole images as interleaved RGB, one row each, from pixel blocks in any order, which are shuffled once."""
    schema = StructType.fromDDL(RGB_IMAGES)
    arrow = to_arrow_schema(schema)
    return blocks.groupBy("image_row", "image_id").applyInArrow(lambda t: pa.Table.from_pylist([_rgb(image_planes(t))], schema=arrow), schema)
