"""The way from pixels to quantised blocks: colour, chroma averaging, forward DCT, quantising.

All in whole numbers, so that the column expressions (:func:`quantized_blocks`), the
numpy pass (:func:`forward`) and SQL give the same coefficients to the last one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

#: The DCT's matrix times 2**BITS; both passes together scale by 2**(2 * BITS).
BITS = 14
MATRIX = [[round((1 << BITS) * math.sqrt((1 if u else 0.5) / 4) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)] for u in range(8)]


def scaled_table(table: list[int], quality: int) -> list[int]:
    """A table for a quality of 1 to 100; 50 leaves it, 100 is all ones."""
    if not 1 <= quality <= 100:
        raise ValueError("quality is 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [max(1, min(255, (v * scale + 50) // 100)) for v in table]


def ycbcr(rgb: np.ndarray) -> np.ndarray:
    """Samples [.., 3] of red, green and blue to luma and differences, 0 to 255."""
    c = (rgb.astype(np.int64) @ np.array(fixed.RGB_WEIGHTS).T + 32768) >> 16
    return np.clip(c + np.array([0, 128, 128]), 0, 255)


def averaged(plane: np.ndarray, x: int, y: int) -> np.ndarray:
    """Means of ``y`` x ``x`` samples, rounded; the last lines and columns are repeated to fill."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % y), (0, -w % x)), mode="edge").reshape(-(-h // y), y, -(-w // x), x)
    return (p.sum((1, 3)) + x * y // 2) // (x * y)


def to_blocks(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Samples as blocks [rows, columns, 64]; the last lines and columns are repeated to fill."""
    h, w = plane.shape
    p = np.pad(plane, ((0, rows * 8 - h), (0, columns * 8 - w)), mode="edge")
    return p.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3).reshape(rows, columns, 64)


def forward(px: np.ndarray, q: list[int]) -> np.ndarray:
    """Blocks of samples [.., 64] to quantised coefficients, rounded half away from zero."""
    m = np.array(MATRIX)
    s = px.reshape(-1, 8, 8).astype(np.int64) - 128
    f = (m @ s @ m.T).reshape(px.shape)
    d = np.array(q, np.int64) << (2 * BITS)
    return np.sign(f) * ((2 * np.abs(f) + d) // (2 * d))


def quantized(px: str, q: str) -> Column:
    """The same of SQL expressions of two arrays of 64 numbers."""
    m = f"array({', '.join('array(' + ', '.join(f'{v}L' for v in row) + ')' for row in MATRIX)})"
    dot = lambda a, b: " + ".join(f"{a.format(k=k)} * {b.format(k=k)}" for k in range(8))
    lines = f"transform(sequence(0, 7), u -> transform(sequence(0, 7), x -> {dot('m[u][{k}]', '(p[{k} * 8 + x] - 128L)')}))"
    both = f"flatten(transform(sequence(0, 7), u -> transform(sequence(0, 7), v -> {dot('t[u][{k}]', 'm[v][{k}]')})))"
    f = f"transform(array({m}), m -> transform(array({px}), p -> transform(array({lines}), t -> {both})[0])[0])[0]"
    return F.expr(f"zip_with({f}, {q}, (f, d) -> cast(signum(f) as bigint) * ((2 * abs(f) + shiftleft(cast(d as bigint), {2 * BITS})) div shiftleft(cast(d as bigint), {2 * BITS + 1})))")


def quantized_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of samples (.., px) and divisors (.., q), 64 each in raster order, to coefficients (.., coef)."""
    return blocks.select(*[c for c in blocks.columns if c not in ("px", "q")], quantized("px", "q").alias("coef"))
