"""OP-68: BMP, TGA and Radiance HDR files from interleaved RGB, and their readers."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _pixels(width: int, height: int, rgb: bytes) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def bmp_bytes(width: int, height: int, rgb: bytes) -> bytes:
    """24 bits a pixel, bottom line first, lines filled up to four bytes."""
    lines = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    lines[:, : 3 * width] = _pixels(width, height, rgb)[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + lines.size, 0, 0, 54, 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0)
    return head + lines.tobytes()


def read_bmp(data: bytes) -> tuple[int, int, bytes]:
    width, height = struct.unpack("<ii", data[18:26])
    lines = np.frombuffer(data, np.uint8, offset=54).reshape(height, -1)[::-1, : 3 * width]
    return width, height, lines.reshape(height, width, 3)[:, :, ::-1].tobytes()


def _packets(line: np.ndarray, longest: int, least: int) -> Iterator[tuple[bool, int, int]]:
    """A line of values [n, ..] as (is a run, from, length): runs of ``least`` or more equal values, and what lies between."""
    n = len(line)
    new = np.flatnonzero((line[1:] != line[:-1]).any(tuple(range(1, line.ndim)))) + 1
    starts = np.concatenate([[0], new])
    sizes = np.diff(np.append(starts, n))
    at = 0  # what is not given yet
    for s, size in zip(starts[sizes >= least].tolist(), sizes[sizes >= least].tolist()):
        yield from ((False, k, min(longest, s - k)) for k in range(at, s, longest))
        yield from ((True, k, min(longest, s + size - k)) for k in range(s, s + size, longest))
        at = s + size
    yield from ((False, k, min(longest, n - k)) for k in range(at, n, longest))


def tga_bytes(width: int, height: int, rgb: bytes) -> bytes:
    """24 bits a pixel, top line first, runs of pixels in packets of up to 128 that end with their line."""
    out = [struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, width, height, 24, 0x20)]
    for line in _pixels(width, height, rgb)[:, :, ::-1]:
        for run, k, n in _packets(line, 128, 2):
            out.append(bytes([n - 1 + 128 * run]) + line[k : k + (1 if run else n)].tobytes())
    return b"".join(out)


def read_tga(data: bytes) -> tuple[int, int, bytes]:
    width, height = struct.unpack("<HH", data[12:16])
    out, at, got = [], 18, 0
    while got < width * height:
        n = (data[at] & 127) + 1
        if data[at] > 127:
            out.append(data[at + 1 : at + 4] * n)
            at += 4
        else:
            out.append(data[at + 1 : at + 1 + 3 * n])
            at += 1 + 3 * n
        got += n
    return width, height, np.frombuffer(b"".join(out), np.uint8).reshape(height, width, 3)[:, :, ::-1].tobytes()


def rgbe(values: np.ndarray) -> np.ndarray:
    """Numbers [.., 3] as three mantissas and the exponent that they share."""
    top = values.max(-1)
    fraction, exponent = np.frexp(top)
    scale = np.where(top < 1e-32, 0, fraction * 256 / np.where(top > 0, top, 1))
    out = np.empty((*values.shape[:-1], 4), np.uint8)
    out[..., :3] = values * scale[..., None]
    out[..., 3] = np.where(top < 1e-32, 0, exponent + 128)
    return out


def hdr_bytes(width: int, height: int, rgb: bytes) -> bytes:
    """Samples over 255 as shared-exponent numbers; each line's four planes with run lengths of their own."""
    out = [f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {height} +X {width}\n".encode()]
    for line in rgbe(_pixels(width, height, rgb) / 255.0):
        if not 8 <= width < 32768:
            out.append(line.tobytes())
            continue
        out.append(bytes([2, 2, width >> 8, width & 255]))
        for plane in line.T:
            for run, k, n in _packets(np.ascontiguousarray(plane), 127, 3):
                out.append(bytes([n + 128, plane[k]]) if run else bytes([n]) + plane[k : k + n].tobytes())
    return b"".join(out)


def read_hdr(data: bytes) -> np.ndarray:
    """The numbers [height, width, 3]."""
    head, _, rest = data.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    _, height, _, width = size.split()
    height, width = int(height), int(width)
    lines = np.zeros((height, width, 4), np.uint8)
    at = 0
    for y in range(height):
        if not 8 <= width < 32768:
            lines[y] = np.frombuffer(body, np.uint8, 4 * width, at).reshape(width, 4)
            at += 4 * width
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < width:
                n = body[at] & 127 if body[at] > 128 else body[at]
                own = body[at + 1] if body[at] > 128 else np.frombuffer(body, np.uint8, n, at + 1)
                lines[y, x : x + n, c] = own
                at += 2 if body[at] > 128 else 1 + n
                x += n
    return lines[..., :3] * np.exp2(lines[..., 3:].astype(float) - 136) * (lines[..., 3:] > 0)


FORMATS: dict[str, Callable[[int, int, bytes], bytes]] = {"bmp": bmp_bytes, "tga": tga_bytes, "hdr": hdr_bytes}
READERS: dict[str, Callable[[bytes], tuple[int, int, bytes]]] = {"bmp": read_bmp, "tga": read_tga}


def encode(images: DataFrame, kind: str) -> DataFrame:
    """(image_id, width, height, rgb) to (image_id, content) of files of ``kind``: bmp, tga or hdr; images without pixels have none."""
    make = FORMATS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if r["rgb"] is None else make(r["width"], r["height"], r["rgb"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(made, pa.binary())], names=["image_id", "content"])

    return images.select("image_id", "width", "height", "rgb").mapInArrow(run, "image_id string, content binary")


def decode(files: DataFrame, kind: str) -> DataFrame:
    """(image_id, width, height, rgb) of bmp or tga files as :func:`encode` makes them."""
    read = READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(i, *read(c)) for i, c in zip(b.column("image_id").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in made], t) for n, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["image_id", "width", "height", "rgb"])

    return files.where("content is not null").select("image_id", "content").mapInArrow(run, "image_id string, width int, height int, rgb binary")
