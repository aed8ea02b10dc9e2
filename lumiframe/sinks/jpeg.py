"""Baseline JPEG streams, from quantised blocks or from pixels.

:func:`encode` takes coefficients, so that decoding can be held against them without
any tolerance; :func:`encode_rgb` makes them of pixels.  Huffman tables are made by a rule, not fitted: either all codes of
one length, or a staircase that uses lengths up to 16.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from ..functions import fixed
from ..functions.fixed import NATURAL_ORDER

_NATURAL = np.array(NATURAL_ORDER)
#: Rows that are Python objects at a time: a block is some kilobytes as such.
_ROWS = 128


def huffman_rule(symbols: list[int], stairs: bool) -> tuple[list[int], list[int]]:
    """Counts and values; with ``stairs`` the first symbols get short codes, the rest 16 bits."""
    counts = [0] * 16
    if stairs:
        short = min(8, len(symbols) - 1)
        for k in range(short):
            counts[k + 1] = 1
        counts[15] = len(symbols) - short
    else:
        counts[max(1, (len(symbols)).bit_length()) - 1] = len(symbols)
    return counts, symbols


def _codes(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[values[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _closed(text: list[str]) -> bytes:
    s = "".join(text)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b""


def _magnitude(v: int) -> tuple[int, int]:
    n = abs(v).bit_length()
    return (v if v > 0 else v + (1 << n) - 1), n


class _Symbols(dict):
    """The bits of a value after a run of up to 15 zeros (``value << 4 | run``), code and magnitude, as text."""

    def __init__(self, rule: tuple[list[int], list[int]]) -> None:
        super().__init__()
        self.code = {s: format(c, f"0{n}b") for s, (c, n) in _codes(*rule).items()}

    def __missing__(self, key: int) -> str:
        value, size = _magnitude(key >> 4)
        if size > 15:
            raise KeyError(key >> 4)
        self[key] = text = self.code[(key & 15) << 4 | size] + (format(value, f"0{size}b") if size else "")
        return text


def _segment(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body


@lru_cache(maxsize=256)
def _divisors(ident: int, table: tuple[int, ...]) -> bytes:
    return _segment(0xDB, bytes([ident]) + bytes(table[i] for i in NATURAL_ORDER))


@lru_cache(maxsize=32)
def _huffman(stairs: bool, huff_ids: tuple[int, int]) -> tuple[bytes, _Symbols, _Symbols]:
    """Both tables as segments, and their symbols."""
    dc = huffman_rule(list(range(12)), stairs)
    ac = huffman_rule([0x00, 0xF0, *[(r << 4) | s for r in range(16) for s in range(1, 11)]], stairs)
    out = b"".join(_segment(0xC4, bytes([(kind << 4) | ident]) + bytes(counts) + bytes(values)) for kind, ident, (counts, values) in ((0, huff_ids[0], dc), (1, huff_ids[1], ac)))
    return out, _Symbols(dc), _Symbols(ac)


def encode(
    width: int,
    height: int,
    sampling: list[tuple[int, int]],
    blocks: list[np.ndarray],
    tables: list[list[int]],
    *,
    restart: int | list[int] = 0,
    scans: list[list[int]] | None = None,
    stairs: bool = False,
    huff_ids: tuple[int, int] = (0, 0),
    extra: bytes = b"",
) -> bytes:
    """``blocks[c]``: [rows, columns, 64] coefficients in raster order, padded to whole MCUs; ``tables[c]``: its divisors.

    ``restart``: one interval, or one for each scan, which is set where it changes.
    """
    n = len(sampling)
    top = [max(s[a] for s in sampling) for a in (0, 1)]
    out = b"\xff\xd8" + extra
    out += b"".join(_divisors(k, tuple(tables[k])) for k in range(n))
    out += _segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, (x << 4) | y, k]) for k, (x, y) in enumerate(sampling)))
    huffman, dc, ac = _huffman(stairs, huff_ids)
    out += huffman
    scans = scans or [list(range(n))]
    intervals, set_to = restart if isinstance(restart, list) else [restart] * len(scans), 0
    for own, restart in zip(scans, intervals):
        if restart != set_to:
            out += _segment(0xDD, struct.pack(">H", restart))
            set_to = restart
        out += _segment(0xDA, bytes([len(own)]) + b"".join(bytes([k + 1, (huff_ids[0] << 4) | huff_ids[1]]) for k in own) + bytes([0, 63, 0]))
        if len(own) == 1:
            x, y = sampling[own[0]] if n > 1 else top
            mcus = [-(-(-(-width * x // top[0])) // 8), -(-(-(-height * y // top[1])) // 8)]
            shape = {own[0]: (1, 1)}
        else:
            mcus = [-(-width // (8 * top[0])), -(-height // (8 * top[1]))]
            shape = {k: sampling[k] for k in own}
        bits, last, parts = [], dict.fromkeys(own, 0), []
        for m in range(mcus[0] * mcus[1]):
            if restart and m and m % restart == 0:
                parts.append(_closed(bits) + bytes([0xFF, 0xD0 + (len(parts) % 8)]))
                bits, last = [], dict.fromkeys(own, 0)
            my, mx = divmod(m, mcus[0])
            for k in own:
                for i in range(shape[k][0] * shape[k][1]):
                    yy, xx = divmod(i, shape[k][0])
                    z = blocks[k][my * shape[k][1] + yy, mx * shape[k][0] + xx, _NATURAL].tolist()
                    bits.append(dc[(z[0] - last[k]) << 4])
                    last[k] = z[0]
                    run = 0
                    for v in z[1:]:
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            bits.append(ac.code[0xF0])
                            run -= 16
                        bits.append(ac[v << 4 | run])
                        run = 0
                    if run:
                        bits.append(ac.code[0])
        parts.append(_closed(bits))
        out += b"".join(parts)
    return out + b"\xff\xd9"


def _slices(batches):
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            yield b.slice(lo, _ROWS)


def encode_blocks(blocks):
    """(image_id, coef, q), 64 values each, to images of one grey 8x8 block (image_id, length, content)."""
    import pyarrow as pa

    def run(batches):
        for b in _slices(batches):
            made = [encode(8, 8, [(1, 1)], [np.array(c, np.int64).reshape(1, 1, 64)], [list(q)]) for c, q in zip(b.column("coef").to_pylist(), b.column("q").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.binary())], names=["image_id", "length", "content"])

    return blocks.select("image_id", "coef", "q").mapInArrow(run, "image_id string, length long, content binary")


ENCODABLE = (
    "image_id string, width int, height int, sampling array<struct<x:int,y:int>>, tables array<array<int>>, restart array<int>, scans array<array<int>>, "
    "blocks array<struct<component_idx:int,block_y:int,block_x:int,coef:array<int>>>"
)


def encode_images(images):
    """Images as rows of ``ENCODABLE`` to streams (image_id, length, content); blocks that are not given are zero."""
    import pyarrow as pa

    def one(r):
        sampling = [(s["x"], s["y"]) for s in r["sampling"]]
        top = [max(s[a] for s in sampling) for a in (0, 1)]
        mcus = [-(-r["width"] // (8 * top[0])), -(-r["height"] // (8 * top[1]))]
        blocks = [np.zeros((mcus[1] * y, mcus[0] * x, 64), np.int64) for x, y in sampling]
        for b in r["blocks"]:
            blocks[b["component_idx"]][b["block_y"], b["block_x"]] = b["coef"]
        return encode(r["width"], r["height"], sampling, blocks, r["tables"], restart=r["restart"], scans=r["scans"])

    def run(batches):
        for b in _slices(batches):
            made = [one(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.binary())], names=["image_id", "length", "content"])

    return images.mapInArrow(run, "image_id string, length long, content binary")


RGB = "image_id string, length long, content binary"


def encode_rgb(images, *, quality: int = 90, sampling: tuple[int, int] = (2, 2), restart: int = 0):
    """OP-68: (image_id, width, height, rgb) to baseline streams (image_id, length, content).

    ``sampling``: luma samples for each chroma sample, across and down; (1, 1) keeps all.
    Images of ``num_components`` 1, where that is a column, become grey.  Rows without
    pixels have no stream.
    """
    import pyarrow as pa

    from ..operators import forward

    x, y = sampling
    if not (1 <= x <= 4 and 1 <= y <= 4 and x * y + 2 <= 10):
        raise ValueError("up to 4 x 4 luma samples a chroma sample, and 8 in all")
    tables = [forward.scaled_table(t, quality) for t in (fixed.LUMA_TABLE, fixed.CHROMA_TABLE, fixed.CHROMA_TABLE)]

    def one(r) -> bytes:
        w, h = r["width"], r["height"]
        c = forward.ycbcr(np.frombuffer(r["rgb"], np.uint8).reshape(h, w, 3))
        grey = r.get("num_components") == 1
        factors = [(1, 1)] if grey else [(x, y), (1, 1), (1, 1)]
        mcus = [-(-w // (8 * factors[0][0])), -(-h // (8 * factors[0][1]))]
        planes = [c[:, :, 0], *([] if grey else [forward.averaged(c[:, :, k], x, y) for k in (1, 2)])]
        blocks = [forward.forward(forward.to_blocks(p, mcus[1] * fy, mcus[0] * fx), q) for p, (fx, fy), q in zip(planes, factors, tables)]
        return encode(w, h, factors, blocks, tables[: len(planes)], restart=restart)

    def run(batches):
        for b in _slices(batches):
            made = [None if r["rgb"] is None else one(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array([None if m is None else len(m) for m in made], pa.int64()), pa.array(made, pa.binary())], names=["image_id", "length", "content"])

    return images.select("image_id", "width", "height", "rgb", *[c for c in ("num_components",) if c in images.columns]).mapInArrow(run, RGB)
