"""Column expressions of the pixel pipeline: all JVM-side, all in BIGINT.

ANSI arithmetic throws where 16-bit hardware wraps, so every store to 16 bits is
an explicit :func:`wrap16`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column, b: Column | int) -> Column:
    """Integer quotient of non-negative numbers."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def ceil_div(a: Column, b: Column | int) -> Column:
    """OP-76: quotient of non-negative numbers, rounded up."""
    b = F.lit(b) if isinstance(b, int) else b
    return idiv(a + b - 1, b)


def wrap16(c: Column) -> Column:
    """What a store to a signed 16-bit number keeps."""
    return (c.cast("bigint") + 32768).bitwiseAND(F.lit(65535).cast("bigint")) - 32768


def clamp8(c: Column) -> Column:
    """OP-57: 0 to 255."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(c.cast("bigint"), F.lit(255).cast("bigint")))


def component_size(size: Column, ss: Column, ss_max: Column) -> Column:
    """OP-08: samples of a component along one axis."""
    return ceil_div(size * ss, ss_max)


def extend(code: Column, bits: Column) -> Column:
    """OP-35: ``bits`` magnitude bits as a signed value (0 bits: 0)."""
    half = F.when(bits > 0, F.expr("1L")).otherwise(F.expr("0L"))
    power = F.pow(F.lit(2), bits).cast("bigint")
    return F.when(bits == 0, F.lit(0).cast("bigint")).when(code * 2 < power, code - power + half).otherwise(code.cast("bigint"))


def zigzag_to_natural(c: str | Column) -> Column:
    """OP-11, OP-40: 64 values in zig-zag order to raster order."""
    c = _col(c)
    place = [0] * 64
    for z, n in enumerate(fixed.NATURAL_ORDER):
        place[n] = z
    return F.transform(F.array(*[F.lit(z) for z in place]), lambda z: F.get(c, z))


def natural_to_zigzag(c: str | Column) -> Column:
    """The inverse of :func:`zigzag_to_natural`."""
    c = _col(c)
    return F.transform(F.array(*[F.lit(n) for n in fixed.NATURAL_ORDER]), lambda n: F.get(c, n))


def is_444(ss_x: Column, ss_y: Column, n: Column) -> Column:
    """OP-18: every one of ``n`` (1 to 4) components is sampled 1x1."""
    ones = lambda a: F.forall(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), lambda v: v == 1)
    return n.between(1, 4) & ones(ss_x) & ones(ss_y)


def status_text(status: Column) -> Column:
    """OP-20: the message of a status."""
    out = F
    for name, text in fixed.STATUS_TEXT.items():
        out = out.when(status == name, text)
    return out.otherwise(fixed.UNKNOWN_STATUS)


def _idct_1d(v: str) -> list[str]:
    """SQL of the 8 outputs of the 1-D fixed-point inverse DCT over ``v[0] .. v[7]``."""
    c4 = fixed.COS_1_4
    even = [
        f"({v}[0] + {v}[4]) * {c4} + ({v}[2] * {fixed.COS_1_8} + {v}[6] * {fixed.SIN_1_8})",
        f"({v}[0] - {v}[4]) * {c4} + ({v}[2] * {fixed.SIN_1_8} - {v}[6] * {fixed.COS_1_8})",
        f"({v}[0] - {v}[4]) * {c4} - ({v}[2] * {fixed.SIN_1_8} - {v}[6] * {fixed.COS_1_8})",
        f"({v}[0] + {v}[4]) * {c4} - ({v}[2] * {fixed.COS_1_8} + {v}[6] * {fixed.SIN_1_8})",
    ]
    plus = f"shiftright(({v}[3] + {v}[5]) * {c4} + 4096, 13)"
    minus = f"shiftright(({v}[3] - {v}[5]) * {c4} + 4096, 13)"
    odd = [
        f"(4 * {v}[1] + {plus}) * {fixed.COS_1_16} + (4 * {v}[7] + {minus}) * {fixed.SIN_1_16}",
        f"(4 * {v}[1] - {plus}) * {fixed.SIN_5_16} - (4 * {v}[7] - {minus}) * {fixed.COS_5_16}",
        f"(4 * {v}[1] - {plus}) * {fixed.COS_5_16} + (4 * {v}[7] - {minus}) * {fixed.SIN_5_16}",
        f"(4 * {v}[1] + {plus}) * {fixed.SIN_1_16} - (4 * {v}[7] + {minus}) * {fixed.COS_1_16}",
    ]
    rounded = lambda x: f"((shiftright({x} + 32768, 16) + 32768) & 65535L) - 32768"
    return [rounded(f"{even[k]} + ({odd[k]})") for k in range(4)] + [rounded(f"{even[k]} - ({odd[k]})") for k in (3, 2, 1, 0)]


def idct_1d(values: str) -> Column:
    """OP-55: the 8-point inverse DCT of an array of 8 BIGINTs (a SQL expression)."""
    return F.expr(f"transform(array({values}), v -> array({', '.join(_idct_1d('v'))}))[0]")


def idct_2d(block: str) -> Column:
    """OP-56: columns, then rows, of an array of 64 dequantised BIGINTs in raster order; 16-bit stores between."""
    one = f"array({', '.join(_idct_1d('v'))})"
    columns = f"transform(sequence(0, 7), c -> transform(array(transform(sequence(0, 7), r -> b[r * 8 + c])), v -> {one})[0])"
    rows = f"flatten(transform(sequence(0, 7), r -> transform(array(transform(sequence(0, 7), c -> m[c][r])), v -> {one})[0]))"
    return F.expr(f"transform(transform(array({block}), b -> {columns}), m -> {rows})[0]")


def dequantize_array(coef: Column, q: Column) -> Column:
    """OP-54: elementwise product, kept to 16 bits."""
    return F.zip_with(coef, q, lambda a, b: wrap16(a.cast("bigint") * b.cast("bigint")))


def to_pixels(samples: Column) -> Column:
    """OP-57: level shift by 128, clamp to 0 .. 255."""
    return F.transform(samples, lambda v: clamp8(wrap16(v + 128)))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    """OP-62: JFIF matrix, rounded half away from zero, clamped."""
    y, cb, cr = y.cast("double"), cb.cast("double") - 128.0, cr.cast("double") - 128.0
    out = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return [F.greatest(F.lit(0.0), F.least(F.round(c), F.lit(255.0))).cast("int") for c in out]
