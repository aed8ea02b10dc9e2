"""OP-67: PNG files from interleaved RGB rows, with row filters."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import Step
from .committed import save_files
from .files import write_files

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one that is closest to left + up - corner; ties: in that order."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(lines: np.ndarray, channels: int) -> np.ndarray:
    """Lines of samples [height, width * channels] as [height, 1 + width * channels]: each by the filter that leaves least.

    The five filters of the PNG standard, for all lines at once; a line takes the one
    with the smallest sum of absolute differences, the lower number on a tie.
    """
    raw = lines.astype(np.int16)
    left, up, corner = np.zeros_like(raw), np.zeros_like(raw), np.zeros_like(raw)
    left[:, channels:], up[1:] = raw[:, :-channels], raw[:-1]
    corner[1:, channels:] = raw[:-1, :-channels]
    made = np.stack([(raw - guess).astype(np.uint8) for guess in (0, left, up, (left + up) >> 1, _paeth(left, up, corner))])
    best = np.abs(made.view(np.int8).astype(np.int32)).sum(2).argmin(0)
    out = np.empty((len(raw), 1 + raw.shape[1]), np.uint8)
    out[:, 0] = best
    out[:, 1:] = made[best, np.arange(len(raw))]
    return out


def unfiltered(lines: np.ndarray, channels: int) -> np.ndarray:
    """The samples of :func:`filtered` lines."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1), np.int64)
    for y, line in enumerate(lines.astype(np.int64), 1):
        kind, diff, up = line[0], line[1:], out[y - 1]
        if kind == 0:
            out[y] = diff
        elif kind == 1:
            out[y] = np.cumsum(diff.reshape(-1, channels), axis=0).ravel() & 255
        elif kind == 2:
            out[y] = (diff + up) & 255
        else:
            own, before = [0] * channels + diff.tolist(), [0] * channels + up.tolist()
            for x in range(channels, len(own)):
                a, b, c = own[x - channels], before[x], before[x - channels]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))
                    guess = near[0][2]
                own[x] = (own[x] + guess) & 255
            out[y] = own[channels:]
    return out[1:].astype(np.uint8)


def png_bytes(width: int, height: int, samples: bytes, level: int = 6, channels: int = 3) -> bytes:
    """8-bit RGB, or grey of one channel, each line filtered."""
    lines = filtered(np.frombuffer(samples, np.uint8).reshape(height, channels * width), channels)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _file(r: dict) -> bytes | None:
    if r["rgb"] is None:
        return None
    grey = r.get("num_components") == 1
    return png_bytes(r["width"], r["height"], r["rgb"][::3] if grey else r["rgb"], channels=1 if grey else 3)


PNG = "image_id string, png binary"


def png_step() -> Step:
    """Batches of RGB images to batches of PNG files; images without pixels have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            png = [_file(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(png, pa.binary())], names=["image_id", "png"])

    return run


def encode_png(images: DataFrame) -> DataFrame:
    """(image_id, width, height, rgb) to (image_id, png); images of ``num_components`` 1, where that is a column, become grey."""
    return images.select("image_id", "width", "height", "rgb", *[c for c in ("num_components",) if c in images.columns]).mapInArrow(png_step(), PNG)


def read_png(files: DataFrame) -> DataFrame:
    """(image_id, width, height, samples) of PNG files as :func:`png_bytes` makes them: r, g, b by row, of grey files too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for image_id, data in zip(b.column("image_id").to_pylist(), b.column("png").to_pylist()):
                width, height = struct.unpack(">II", data[16:24])
                at, body = 8, b""
                while at < len(data):
                    size = int.from_bytes(data[at : at + 4], "big")
                    if zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
                        raise ValueError(f"{image_id}: a chunk of the file is corrupt")
                    body += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
                    at += 12 + size
                channels = 3 if data[25] == 2 else 1
                lines = unfiltered(np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + channels * width), channels)
                out.append({"image_id": image_id, "width": width, "height": height, "samples": np.repeat(lines.ravel(), 3 // channels).astype(np.int16)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.list_(pa.int16()))]))

    return files.where("png is not null").select("image_id", "png").mapInArrow(run, "image_id string, width int, height int, samples array<smallint>")


def save_png(files: DataFrame, folder: str, *, mode: str = "append") -> None:
    """Writes ``<sha1 of image_id>.png`` below ``folder`` from (image_id, png): all files of the job, or none."""
    save_files(files.where("png is not null").select(F.concat(F.sha1("image_id"), F.lit(".png")).alias("name"), F.col("png").alias("content")), folder, mode=mode)


def write_png(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``folder/<sha1 of image_id>.png`` from (image_id, png); gives (image_id, file)."""
    named = files.where("png is not null").select("image_id", F.concat(F.sha1("image_id"), F.lit(".png")).alias("file"), "png")
    return write_files(named, folder, content_col="png")
