"""One object for an image collection: every stage as a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import color, compare, dealing, decode, huffman, lookups
from ..operators.reconstruct import to_pixel_rows
from ..sinks import png, raster
from ..sources import header, images, ranged
from . import functions


#: The methods that :meth:`RasterCollection.register` makes views of.
TABLES = [
    "frames", "markers", "components", "scans", "scan_components", "qtables", "huff_tables", "huff_codes", "image_info", "cost",
    "segments", "coefficients", "pixel_blocks", "pixels", "planes", "rgb",
]


class RasterCollection:
    """Images and what can be asked of them.

    Metadata (``frames``, ``markers`` ..) never touches the pixel path, and filters
    belong on the images before: ``RasterCollection(df.where(...))``.
    """

    def __init__(self, source: DataFrame, *, partitions: int | None = None) -> None:
        self.images, self.partitions = source, partitions

    @classmethod
    def read(cls, spark: SparkSession, path: str | list[str], **options) -> RasterCollection:
        reading = {k: options.pop(k) for k in ("pattern",) if k in options}
        return cls(images.read_images(spark, path, **reading), **options)

    @classmethod
    def read_dealt(cls, spark: SparkSession, path: str | list[str], tasks: int, *, pattern: str = ranged.PATTERN) -> RasterCollection:
        """Whole files in ``tasks`` tasks of about equal decoding cost (units by the headers, which are read by ranges)."""
        files = ranged.list_files(spark, path, pattern=pattern).select("image_id")
        units = lookups.decode_cost(ranged.headers(files)).select("image_id", "units")
        return cls(ranged.contents(dealing.deal(files.join(units, "image_id", "left"), "units", tasks)))

    @classmethod
    def read_ranged(cls, spark: SparkSession, path: str | list[str], *, pattern: str = ranged.PATTERN, size: int = ranged.RANGE) -> RangedCollection:
        """Files that are never read whole by one task: headers by ranges, and each scan's bytes by ranges of ``size``."""
        return RangedCollection(ranged.list_files(spark, path, pattern=pattern), size)

    @cached_property
    def headers(self) -> DataFrame:
        return header.headers(self.images)

    def frames(self) -> DataFrame:
        return lookups.with_status_text(header.frame_rows(self.images))

    def markers(self) -> DataFrame:
        return header.markers(self.headers)

    def components(self) -> DataFrame:
        return header.components(self.headers)

    def scans(self) -> DataFrame:
        return header.scans(self.headers)

    def scan_components(self) -> DataFrame:
        return header.scan_components(self.headers)

    def qtables(self) -> DataFrame:
        return header.qtables(self.headers)

    def huff_tables(self) -> DataFrame:
        return header.huff_tables(self.headers)

    def huff_codes(self) -> DataFrame:
        """OP-10: a row for each code of each table."""
        return huffman.canonical_codes(self.huff_tables())

    def image_info(self) -> DataFrame:
        return lookups.with_is_444(header.image_info(self.headers))

    def cost(self) -> DataFrame:
        return lookups.decode_cost(self.headers)

    def _parts(self) -> DataFrame:
        found = decode.parts(self.images)
        return decode.spread(found, self.partitions) if self.partitions else found

    def segments(self) -> DataFrame:
        return decode.segments(decode.parts(self.images))

    def coefficients(self) -> DataFrame:
        return decode.coefficient_blocks(self._parts())

    def pixel_blocks(self) -> DataFrame:
        return decode.pixel_blocks(self._parts()) if self.partitions else decode.image_pixel_blocks(self.images)

    def pixels(self) -> DataFrame:
        rows = to_pixel_rows(self.pixel_blocks())
        return rows.where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))).select("image_id", "component_idx", "y", "x", "v")

    def planes(self) -> DataFrame:
        """Without ``partitions`` an image stays in its task from bits to planes; nothing is shuffled."""
        if self.partitions:
            return decode.planes(decode.packed_blocks(self._parts()))
        return self._in_one_pass(schemas.PLANES, decode.pixel_step(of_images=True), decode.plane_step())

    def rgb(self) -> DataFrame:
        if self.partitions:
            return color.rgb_images(decode.packed_blocks(self._parts()))
        return self._in_one_pass(color.RGB_IMAGES, decode.pixel_step(of_images=True), decode.plane_step(), color.rgb_step())

    def png(self) -> DataFrame:
        if self.partitions:
            return png.encode_png(self.rgb())
        return self._in_one_pass(png.PNG, decode.pixel_step(of_images=True), decode.plane_step(), color.rgb_step(), png.png_step())

    def _in_one_pass(self, ddl: str, *steps: decode.Step) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for step in steps:
                batches = step(batches)
            return batches

        return decode.with_row(self.images).mapInArrow(run, ddl)

    def mse(self, other: RasterCollection) -> DataFrame:
        return compare.block_mse(self.pixel_blocks(), other.pixel_blocks())

    def structure_diff(self, other: RasterCollection) -> DataFrame:
        return compare.structure_diff(self.components(), other.components())

    def write_png(self, folder: str) -> DataFrame:
        return png.write_png(self.png(), folder)

    def encoded(self, kind: str) -> DataFrame:
        """(image_id, content): files of ``kind``: bmp, tga or hdr."""
        return raster.encode(self.rgb(), kind)

    def save_png(self, folder: str, *, mode: str = "append") -> None:
        """Runs the decode and writes PNG files with a commit: after a failure there are none."""
        png.save_png(self.png(), folder, mode=mode)

    def latency(self, *, iterations: int = 1, warm_up: int = 0) -> DataFrame:
        """What decoding each image took, from bytes to planes, in its task; see :func:`.decode.timed`."""
        return decode.timed(self.images, iterations=iterations, warm_up=warm_up)

    def register(self, prefix: str = "") -> None:
        """All tables as temporary views, for SQL; each is computed only when a query reads it.  Also the table functions."""
        functions.register(self.images.sparkSession)
        for name in TABLES:
            getattr(self, name)().createOrReplaceTempView(prefix + name)


class RangedCollection(RasterCollection):
    """Files by ranges (:mod:`.sources.ranged`): metadata without the pixels, pixels of one file from many tasks.

    A file whose scans do not all end has no pixels.  ``scans`` does not say how many
    segments a scan has; :meth:`scan_segments` does.
    """

    def __init__(self, files: DataFrame, size: int = ranged.RANGE) -> None:
        super().__init__(files)
        self.size = size
        self.partitions = 1  # planes are put together by image

    @cached_property
    def headers(self) -> DataFrame:
        return ranged.headers(self.images)

    def frames(self) -> DataFrame:
        """Read no further than the frame."""
        return lookups.with_status_text(header.frames(ranged.headers(self.images, frame_only=True)))

    def components(self) -> DataFrame:
        return header.components(ranged.headers(self.images, frame_only=True))

    def scan_segments(self) -> DataFrame:
        return ranged.scan_segments(self.images, size=self.size)

    def segments(self) -> DataFrame:
        return decode.segments(self._parts())

    def _parts(self) -> DataFrame:
        return ranged.parts(self.images, size=self.size)

    def latency(self, *, iterations: int = 1, warm_up: int = 0) -> DataFrame:
        raise NotImplementedError("one file's decode is many tasks here; read whole files to time them")
