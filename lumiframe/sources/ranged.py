"""Files by ranges: headers without reading the pixels, and one large file over many tasks.

Files are listed by Spark (``binaryFile`` without its content column, so filters on
path, length and time prune before anything is opened); tasks open them by path and
read the blocks that the parser asks for.  Application segments are skipped unread,
and reading ends at the first scan that leaves no component over.

The entropy-coded data of one file are cut into byte ranges:

1. a first pass over ranges counts restart markers and notes where the last one and
   the scan's end lie (a marker that straddles a cut belongs to the range that has its
   second byte);
2. these summaries, one row a range, are composed by running sums and maxima;
3. a second pass reads each range again, from the end of the last marker before it,
   and gives the segments that end in it.

Tasks reach files through :mod:`pyarrow.fs` (local paths, HDFS, S3, GCS), not through
Spark's file systems; for other stores read whole files with :mod:`.images`.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.fixed import INVALID_JPEG, SUBSEQUENCE_BYTES, SUCCESS
from .header import Header, Parser, Stop
from .paths import open_path, resolve, split

BLOCK, RANGE = 4 << 10, 4 << 20
PATTERN = "*.[jJ][pP]*[gG]"
#: The pixels' bytes and where a scan ends are not looked at: ``end`` is null and ``segments`` empty where not passed on the way.
HEADER = f"{schemas.HEADER}, length bigint, bytes_read bigint, reads int"
_MARK = re.compile(rb"\xff+[^\x00\xff]")


class Blocks:
    """The bytes of an open file, read where they are looked at, in whole blocks."""

    def __init__(self, file, block: int = BLOCK) -> None:
        self.file, self.block, self.size = file, block, file.size()
        self.held: dict[int, bytes] = {}
        self.bytes_read = self.reads = 0

    def __len__(self) -> int:
        return self.size

    def _at(self, k: int) -> bytes:
        if k not in self.held:
            self.held[k] = self.file.read_at(min(self.block, self.size - k * self.block), k * self.block)
            self.bytes_read += len(self.held[k])
            self.reads += 1
        return self.held[k]

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self._at(at // self.block)[at % self.block]
        lo, hi, _ = at.indices(self.size)
        if hi <= lo:
            return b""
        first = lo // self.block
        joined = b"".join(self._at(k) for k in range(first, (hi - 1) // self.block + 1))
        return joined[lo - first * self.block : hi - first * self.block]

    def stream(self, lo: int, blocks: int = 256) -> Iterator[tuple[int, bytes]]:
        """Pieces from ``lo`` on, ``blocks`` read at once; only the last of these are held."""
        while lo < self.size:
            k = lo // self.block
            if k not in self.held:
                piece = self.file.read_at(min(blocks * self.block, self.size - k * self.block), k * self.block)
                self.bytes_read += len(piece)
                self.reads += 1
                self.held = {k + i: piece[i * self.block : (i + 1) * self.block] for i in range(-(-len(piece) // self.block))}
            yield lo, self.held[k][lo % self.block :]
            lo = (k + 1) * self.block


class _Enough(Exception):
    pass


class HeaderParser(Parser):
    """The parser of whole streams, on a file's blocks: up to the frame, or to the first scan that no other can follow."""

    def __init__(self, data: Blocks, frame_only: bool = False) -> None:
        super().__init__(data)
        self.frame_only = frame_only

    def _walk(self) -> None:
        try:
            super()._walk()
        except _Enough:
            pass

    def _frame(self) -> None:
        super()._frame()
        if self.frame_only:
            raise _Enough

    def _entropy(self, scan: dict) -> None:
        if len(self.scanned) == len(self.h.components):
            self.h.scans.append(scan | {"end": None})
            raise _Enough
        before = b""
        for at, piece in self.c.data.stream(self.c.at):
            own = before + piece
            for m in _MARK.finditer(own):
                if not 0xD0 <= own[m.end() - 1] <= 0xD7:
                    scan["end"] = self.c.at = at - len(before) + m.end() - 2
                    return
            before = own[-1:] if own.endswith(b"\xff") else b""
        raise Stop(INVALID_JPEG)


def read_header(path: str, frame_only: bool = False, block: int = BLOCK) -> tuple[Header, int, int, int]:
    """A file's header, its length, and how many bytes were read in how many reads."""
    with open_path(path) as f:
        data = Blocks(f, block)
        h = HeaderParser(data, frame_only).parse()
        return h, len(data), data.bytes_read, data.reads


def list_files(spark: SparkSession, path: str | list[str], *, pattern: str = PATTERN) -> DataFrame:
    """(image_id, length, modificationTime) of the files under ``path``; none is opened.  Spark passes over empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("image_id"), "length", "modificationTime")


def headers(files: DataFrame, *, frame_only: bool = False) -> DataFrame:
    """OP-02 to OP-17 by ranges: rows of ``HEADER`` for files (image_id: a path).

    A status tells of what was read: whether a file is whole shows only when its scans
    are read.  ``frame_only``: no further than the frame, without tables and scans.
    """
    schema = StructType.fromDDL(HEADER)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("image_id").to_pylist():
                h, length, read, reads = read_header(path, frame_only)
                rows.append(vars(h) | {"image_id": path, "num_components": len(h.components), "length": length, "bytes_read": read, "reads": reads})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("image_id").mapInArrow(run, schema)


def contents(files: DataFrame, *, batch_bytes: int = 64 << 20) -> DataFrame:
    """(image_id, length, content) of files, read where they have been dealt to, in batches of about ``batch_bytes``."""
    names = ["image_id", "length", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for path in b.column("image_id").to_pylist():
                with open_path(path) as f:
                    held.append((path, f.read()))
                size += len(held[-1][1])
                if size >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in held]), pa.array([len(d) for _, d in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in held]), pa.array([len(d) for _, d in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], names=names)

    return files.select("image_id").mapInArrow(run, "image_id string, length bigint, content binary")


# ---------------------------------------------------------------- one file over many tasks


def _ranges(parsed: DataFrame, size: int) -> DataFrame:
    """(image_id, scan_idx, begin, part, lo, hi, header): the byte ranges in which scans lie."""
    s = parsed.where(F.col("status") == SUCCESS).select("image_id", "length", "components", F.explode("scans").alias("scan"))
    cut = F.expr(f"transform(sequence(0L, greatest(0L, (coalesce(scan.end + 2, length) - scan.begin - 1) div {size})), k -> struct(k as part, scan.begin + k * {size} as lo, least(scan.begin + (k + 1) * {size}, coalesce(scan.end + 2, length)) as hi))")
    return s.select("image_id", "scan", "components", F.explode(cut).alias("r")).select("image_id", F.col("scan.scan_idx").alias("scan_idx"), F.col("scan.begin").alias("begin"), "r.*", "scan", "components")


_SUMMARY = "image_id string, scan_idx int, part bigint, restarts bigint, last bigint, stop bigint"


def _summaries(ranges: DataFrame) -> DataFrame:
    """Of each range: its restart markers up to the scan's end, where the last of them ends, and where the marker that ends the scan begins."""
    arrow = to_arrow_schema(StructType.fromDDL(_SUMMARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                back = int(r["lo"] > r["begin"])
                with open_path(r["image_id"]) as f:
                    data = f.read_at(r["hi"] - r["lo"] + back, r["lo"] - back)
                at, restarts, last, stop = r["lo"] - back, 0, None, None
                for m in _MARK.finditer(data):
                    if not 0xD0 <= data[m.end() - 1] <= 0xD7:
                        stop = at + m.end() - 2
                        break
                    restarts, last = restarts + 1, at + m.end()
                rows.append({"image_id": r["image_id"], "scan_idx": r["scan_idx"], "part": r["part"], "restarts": restarts, "last": last, "stop": stop})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ranges.select("image_id", "scan_idx", "part", "begin", "lo", "hi").mapInArrow(run, _SUMMARY)


def _carried(ranges: DataFrame) -> DataFrame:
    """Ranges of scans that end, up to their end, with ``first`` (segments before) and ``since`` (where the open one begins)."""
    before = W.partitionBy("image_id", "scan_idx").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("image_id", "scan_idx")
    s = _summaries(ranges).select("image_id", "scan_idx", "part", F.coalesce(F.sum("restarts").over(before), F.lit(0)).alias("first"), F.max("last").over(before).alias("since"), F.min("stop").over(before).alias("over"), F.min("stop").over(whole).alias("stop"))
    own = s.where("over is null and stop is not null").select("image_id", "scan_idx", "part", "first", "since", "stop")
    return ranges.join(own, ["image_id", "scan_idx", "part"]).withColumn("since", F.coalesce("since", "begin"))


def _segments_of(r: dict) -> Iterator[tuple[int, int, int, bytes]]:
    """Number, begin and end of the segments that end in a range, and their bytes as they stand."""
    hi = min(r["hi"], r["stop"] + 2)
    with open_path(r["image_id"]) as f:
        data = f.read_at(hi - r["since"], r["since"])
    number, start, base = r["first"], 0, r["since"]
    # what ended before the range has been given there: no marker lies between ``since`` and it
    for m in _MARK.finditer(data):
        yield number, base + start, base + m.start(), data[start : m.start()]
        number, start = number + 1, m.end()


_SEGMENTS = "image_id string, scan_idx int, segment_idx int, begin bigint, end bigint, num_bytes bigint"


def _dealt(ranges: DataFrame, tasks: int | None) -> DataFrame:
    """Ranges over ``tasks``; by number, since rows are tiny and adaptive execution would join them again."""
    spark = ranges.sparkSession
    return ranges.repartition(tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "image_id", "scan_idx", "part")


def scan_segments(files: DataFrame, *, size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """OP-22, OP-23: (image_id, scan_idx, segment_idx, begin, end, num_bytes), each file read by many tasks.

    ``size``: bytes of a range.  Scans that do not end have no rows.
    """
    arrow = to_arrow_schema(StructType.fromDDL(_SEGMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = [{"image_id": r["image_id"], "scan_idx": r["scan_idx"], "segment_idx": k, "begin": lo, "end": hi, "num_bytes": len(own) - own.count(b"\xff\x00")} for k, lo, hi, own in _segments_of(r)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ranges = _dealt(_ranges(headers(files), size).select("image_id", "scan_idx", "begin", "part", "lo", "hi"), tasks)
    return _dealt(_carried(ranges), tasks).select("image_id", "scan_idx", "since", "hi", "stop", "first").mapInArrow(run, _SEGMENTS)


def parts(files: DataFrame, *, size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """Runs of segments ready to be decoded (``schemas.PARTS``), each file read by many tasks."""
    from ..operators.decode import scan_facts

    arrow = to_arrow_schema(StructType.fromDDL(schemas.PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                scan = r["scan"]
                facts = {"image_row": r["image_row"], "image_id": r["image_id"]} | scan_facts(Header(components=r["components"]), scan)
                total = scan["num_mcus_x"] * scan["num_mcus_y"]
                each = scan["restart_interval"] or total
                own = [
                    {"segment_idx": k, "subseq_offset": None, "subseq_count": -(-len(data) // SUBSEQUENCE_BYTES), "data": data, "first_mcu": k * each, "num_mcus": min(each, total - k * each)}
                    for k, _, _, raw in _segments_of(r) if k * each < total for data in [raw.replace(b"\xff\x00", b"\xff")]
                ]
                if own:
                    yield pa.RecordBatch.from_pylist([facts | {"segments": own}], schema=arrow)

    ranges = _dealt(_ranges(headers(files), size), tasks)
    return _dealt(_carried(ranges), tasks).withColumn("image_row", F.xxhash64("image_id")).mapInArrow(run, schemas.PARTS)


# ---------------------------------------------------------------- as a data source

_FRAME = "image_id string, length bigint, status string, precision int, width int, height int, num_components int, ss_max_x int, ss_max_y int"
TABLES = {
    "headers": HEADER,
    "frames": _FRAME,
    "components": "image_id string, length bigint, component_idx int, id int, ss_x int, ss_y int, qtable_idx int, width int, height int",
    "qtables": "image_id string, length bigint, scan_idx int, table_id int, q array<smallint>",
    "huff_tables": "image_id string, length bigint, scan_idx int, class int, slot int, counts array<int>, huffval array<int>",
}


def _table_rows(table: str, path: str) -> list[dict]:
    h, length, read, reads = read_header(path, table in ("frames", "components"))
    file = {"image_id": path, "length": length}
    if table == "headers":
        return [vars(h) | file | {"num_components": len(h.components), "bytes_read": read, "reads": reads}]
    if table == "frames":
        return [vars(h) | file | {"num_components": len(h.components)}]
    if table == "components":
        return [file | c for c in h.components]
    return [file | {"scan_idx": s["scan_idx"]} | t for s in h.scans for t in s[table]]


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
}


class FileRange(InputPartition):
    """Files of one task."""

    def __init__(self, files: list[str]) -> None:
        self.files = files


class HeaderReader(DataSourceReader):
    """Lists files, drops those that pushed filters on ``image_id`` and ``length`` exclude, and reads the others by ranges."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options, self.tests = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("image_id",), ("length",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        scheme = split(self.options["path"])[0]
        at, inside = resolve(self.options["path"])
        # listed paths begin with the inside one; the rest of the given path goes before
        root = self.options["path"][: len(self.options["path"]) - len(inside)] if scheme else ""
        found = []
        for info in at.get_file_info(fs.FileSelector(inside, recursive=True)):
            file = {"image_id": root + info.path, "length": info.size}
            if info.is_file and fnmatch.fnmatchcase(info.base_name, self.options.get("pattern", PATTERN)) and all(_TESTS[kind](file[column], value) for column, kind, value in self.tests):
                found.append(file["image_id"])
        each = int(self.options.get("filespertask", 1000))
        return [FileRange(found[k : k + each]) for k in range(0, len(found), each)] or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        arrow, table = to_arrow_schema(self.schema), self.options.get("table", "headers")
        for lo in range(0, len(partition.files), 256):
            rows = [r for path in partition.files[lo : lo + 256] for r in _table_rows(table, path)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class JpegHeaders(DataSource):
    """``spark.read.format("jpeg_headers").option("table", "frames").load(folder)``, also in SQL as ``CREATE TABLE .. USING``.

    ``table``: headers, frames, components, qtables or huff_tables; frames and
    components read no further than the frame.  Register it with :func:`register`.
    The driver lists the folder; for many millions of files :func:`list_files` lists them
    as Spark does, over the cluster.
    """

    @classmethod
    def name(cls) -> str:
        return "jpeg_headers"

    def schema(self) -> str:
        table = self.options.get("table", "headers")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to this session, filters on paths and lengths being pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JpegHeaders)
