"""Random images as quantised blocks, and the streams that hold them."""

from __future__ import annotations

import numpy as np

from lumiframe.sinks.jpeg import encode


def random_blocks(width, height, sampling, seed=0, dense=0.15, top=300):
    rng = np.random.default_rng(seed)
    mx, my = (max(s[a] for s in sampling) for a in (0, 1))
    mcus = (-(-width // (8 * mx)), -(-height // (8 * my)))
    out = []
    for x, y in sampling:
        b = rng.integers(-top, top + 1, (mcus[1] * y, mcus[0] * x, 64))
        b[..., 1:] //= 8
        b[rng.random(b.shape) > dense] = 0
        out.append(b.astype(np.int64))
    return out


def image(width=20, height=13, sampling=((2, 2), (1, 1), (1, 1)), seed=0, tables=None, **options):
    """(stream, blocks, tables)."""
    sampling = [tuple(s) for s in sampling]
    if len(sampling) == 1:
        sampling = [(1, 1)]
    blocks = random_blocks(width, height, sampling, seed)
    tables = tables or [[1 + (k + i) % 20 for i in range(64)] for k in range(len(sampling))]
    return encode(width, height, sampling, blocks, tables, **options), blocks, tables


def table(spark, streams):
    return spark.createDataFrame([(k, len(v) if v is not None else None, v) for k, v in streams.items()], "image_id string, length long, content binary")
