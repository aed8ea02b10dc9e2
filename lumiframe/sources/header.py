"""Headers of baseline JPEG streams, parsed to rows; no pixel is decoded here.

The parser follows ITU-T T.81.  A file that breaks it, or needs what baseline
decoding lacks, gives a row with a status instead of an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from .. import schemas
from ..functions.fixed import INCOMPLETE, INVALID_JPEG, MAX_COMPONENTS, MAX_SCANS, MAX_UNITS_IN_MCU, NATURAL_ORDER, NOT_SUPPORTED, SUBSEQUENCE_BYTES, SUCCESS

SOI, EOI, SOS, DHT, DQT, DRI = 0xD8, 0xD9, 0xDA, 0xC4, 0xDB, 0xDD
OTHER_FRAMES = {0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
#: An FF in entropy-coded data that is no stuffed byte: a marker, with any fill bytes before it.
_MARK = re.compile(rb"\xff+[^\x00\xff]")


class Stop(Exception):
    """Ends parsing with a status."""


@dataclass
class Header:
    status: str = SUCCESS
    precision: int = 0
    width: int = 0
    height: int = 0
    ss_max_x: int = 0
    ss_max_y: int = 0
    restart_interval: int = 0
    markers: list[dict] = field(default_factory=list)
    components: list[dict] = field(default_factory=list)
    scans: list[dict] = field(default_factory=list)


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def need(self, n: int, status: str) -> None:
        if len(self.data) - self.at < n:
            raise Stop(status)

    def u8(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def u16(self) -> int:
        self.at += 2
        return int.from_bytes(self.data[self.at - 2 : self.at], "big")

    def take(self, n: int) -> list[int]:
        self.at += n
        return list(self.data[self.at - n : self.at])

    def marker(self) -> int:
        self.need(2, INVALID_JPEG)
        if self.u8() != 0xFF:
            raise Stop(INVALID_JPEG)
        code = self.u8()
        while code == 0xFF:  # fill bytes
            self.need(1, INVALID_JPEG)
            code = self.u8()
        return code

    def body(self, short: str, cut: str) -> int:
        """Reads a segment's length; gives where the segment ends."""
        self.need(2, cut)
        length = self.u16()
        if length < 2:
            raise Stop(short)
        self.need(length - 2, cut)
        return self.at + length - 2


class Parser:
    """One image; nothing is kept from one to the next."""

    def __init__(self, data: bytes) -> None:
        self.c, self.h = _Cursor(data), Header()
        self.framed = False
        self.quant: dict[int, list[int]] = {}
        self.huff: dict[int, dict] = {}
        self.scanned: set[int] = set()

    def parse(self) -> Header:
        try:
            self._walk()
        except Stop as stop:
            self.h.status = str(stop)
        return self.h

    def _walk(self) -> None:
        code = self._next()
        if code != SOI:
            raise Stop(INVALID_JPEG)
        while (code := self._next()) != EOI:
            if code in (0xC0, 0xC1):
                self._frame()
            elif code in OTHER_FRAMES:
                raise Stop(NOT_SUPPORTED)
            elif code == DHT:
                self._huffman()
            elif code == DQT:
                self._quantisation()
            elif code == DRI:
                self._restart()
            elif code == SOS:
                self._scan()
            else:
                self.c.at = self.c.body(INVALID_JPEG, INCOMPLETE)
        if not self.framed or len(self.scanned) < len(self.h.components):
            raise Stop(INVALID_JPEG)

    def _next(self) -> int:
        code = self.c.marker()
        alone = code in (SOI, EOI) or 0xD0 <= code <= 0xD7
        left = len(self.c.data) - self.c.at
        length = 0 if alone or left < 2 else int.from_bytes(self.c.data[self.c.at : self.c.at + 2], "big")
        self.h.markers.append({"ord": len(self.h.markers), "offset": self.c.at - 2, "code": code, "length": length})
        return code

    def _frame(self) -> None:
        c, h = self.c, self.h
        if self.framed:
            raise Stop(INVALID_JPEG)
        c.need(2, INCOMPLETE)
        length = c.u16()
        if length < 8:
            raise Stop(INVALID_JPEG)
        c.need(6, INCOMPLETE)
        h.precision, h.height, h.width, n = c.u8(), c.u16(), c.u16(), c.u8()
        if h.precision != 8:
            raise Stop(NOT_SUPPORTED)
        if not (h.width and h.height and n):
            raise Stop(INVALID_JPEG)
        if n > MAX_COMPONENTS:
            raise Stop(NOT_SUPPORTED)
        c.need(3 * n, INCOMPLETE)
        if length != 8 + 3 * n:
            raise Stop(INVALID_JPEG)
        for k in range(n):
            ident, ss, q = c.u8(), c.u8(), c.u8()
            x, y = ss >> 4, ss & 15
            if not (1 <= x <= 4 and 1 <= y <= 4) or q > 3:
                raise Stop(INVALID_JPEG)
            if n == 1:
                x = y = 1
            h.components.append({"component_idx": k, "id": ident, "ss_x": x, "ss_y": y, "qtable_idx": q})
        h.ss_max_x, h.ss_max_y = (max(p[a] for p in h.components) for a in ("ss_x", "ss_y"))
        for p in h.components:
            p["width"], p["height"] = -(-h.width * p["ss_x"] // h.ss_max_x), -(-h.height * p["ss_y"] // h.ss_max_y)
        self.framed = True

    def _huffman(self) -> None:
        c = self.c
        end = c.body(INVALID_JPEG, INVALID_JPEG)
        if end == c.at:
            raise Stop(INVALID_JPEG)
        while c.at < end:
            if end - c.at < 17:
                raise Stop(INVALID_JPEG)
            kind, ident = divmod(c.u8(), 16)
            if kind > 1:
                raise Stop(INVALID_JPEG)
            if ident > 3:
                raise Stop(NOT_SUPPORTED)
            counts = c.take(16)
            if sum(counts) > 256 or end - c.at < sum(counts):
                raise Stop(INVALID_JPEG)
            self.huff[2 * ident + kind] = {"class": kind, "slot": 2 * ident + kind, "counts": counts, "huffval": c.take(sum(counts))}

    def _quantisation(self) -> None:
        c = self.c
        end = c.body(INVALID_JPEG, INVALID_JPEG)
        while c.at < end:
            precision, ident = divmod(c.u8(), 16)
            if precision > 1 or ident > 3:
                raise Stop(INVALID_JPEG)
            if precision:
                raise Stop(NOT_SUPPORTED)
            if end - c.at < 64:
                raise Stop(INVALID_JPEG)
            table = [0] * 64
            for n, v in zip(NATURAL_ORDER, c.take(64)):
                table[n] = v
            self.quant[ident] = table

    def _restart(self) -> None:
        end = self.c.body(INVALID_JPEG, INVALID_JPEG)
        if end - self.c.at != 2:
            raise Stop(INVALID_JPEG)
        value = self.c.u16()
        if self.h.restart_interval and value != self.h.restart_interval:
            raise Stop(NOT_SUPPORTED)
        self.h.restart_interval = value

    def _scan(self) -> None:
        c, h = self.c, self.h
        if not self.framed:
            raise Stop(INVALID_JPEG)
        c.need(3, INCOMPLETE)
        length, n = c.u16(), c.u8()
        if not 1 <= n <= MAX_COMPONENTS or len(h.scans) == MAX_SCANS or length != 6 + 2 * n:
            raise Stop(INVALID_JPEG)
        c.need(2 * n + 3, INCOMPLETE)
        by_id: dict[int, dict] = {}
        for p in h.components:
            by_id.setdefault(p["id"], p)
        parts, last = [], -1
        for k in range(n):
            selector, tables = c.u8(), c.u8()
            dc, ac = tables >> 4, tables & 15
            p = by_id.get(selector)
            if p is None or p["component_idx"] <= last or p["component_idx"] in self.scanned or dc > 3 or ac > 3:
                raise Stop(INVALID_JPEG)
            if 2 * dc not in self.huff or 2 * ac + 1 not in self.huff or p["qtable_idx"] not in self.quant:
                raise Stop(INVALID_JPEG)
            last = p["component_idx"]
            parts.append((p, dc, ac))
        if (c.u8(), c.u8(), c.u8()) != (0, 63, 0):
            raise Stop(NOT_SUPPORTED)
        # T.81 A.2: one data unit an MCU if the scan has one component
        shape = [(1, 1)] if n == 1 else [(p["ss_x"], p["ss_y"]) for p, _, _ in parts]
        units = sum(x * y for x, y in shape)
        if n > 1 and units > MAX_UNITS_IN_MCU:
            raise Stop(INVALID_JPEG)
        if n == 1:
            mcus = [-(-parts[0][0][a] // 8) for a in ("width", "height")]
        else:
            mcus = [-(-h.width // (8 * h.ss_max_x)), -(-h.height // (8 * h.ss_max_y))]
        used = [
            {"sc": k, "component_idx": p["component_idx"], "dc_idx": dc, "ac_idx": ac, "mcu_x": 8 * x, "mcu_y": 8 * y, "data_x": 8 * x * mcus[0], "data_y": 8 * y * mcus[1]}
            for k, ((p, dc, ac), (x, y)) in enumerate(zip(parts, shape))
        ]
        self.scanned |= {p["component_idx"] for p, _, _ in parts}
        # tables and restart interval as they stand where the scan begins
        scan = {
            "scan_idx": len(h.scans), "begin": c.at, "end": c.at, "num_mcus_x": mcus[0], "num_mcus_y": mcus[1], "units_in_mcu": units, "restart_interval": h.restart_interval, "components": used,
            "qtables": [{"table_id": q, "q": self.quant[q]} for q in sorted({p["qtable_idx"] for p, _, _ in parts})],
            "huff_tables": [dict(self.huff[s]) for s in sorted({2 * dc for _, dc, _ in parts} | {2 * ac + 1 for _, _, ac in parts})],
            "segments": [],
        }
        self._entropy(scan)
        h.scans.append(scan)

    def _entropy(self, scan: dict) -> None:
        """The scan's segments, up to the marker that ends it."""
        c, start = self.c, self.c.at
        while True:
            m = _MARK.search(c.data, c.at)
            if m is None:
                raise Stop(INVALID_JPEG)
            scan["segments"].append({"segment_idx": len(scan["segments"]), "begin": start, "end": m.start(), "num_bytes": m.start() - start - c.data.count(b"\xff\x00", start, m.start())})
            if not 0xD0 <= c.data[m.end() - 1] <= 0xD7:
                scan["end"] = c.at = m.end() - 2
                return
            c.at = start = m.end()


def parse(data: bytes | None) -> Header:
    """Parse one stream; a null one is an invalid argument."""
    if data is None:
        return Header(status="INVALID_ARGUMENT")
    return Parser(bytes(data)).parse()


def _arrow(ddl: str) -> tuple[StructType, pa.Schema]:
    schema = StructType.fromDDL(ddl)
    return schema, to_arrow_schema(schema)


#: Headers that are Python objects at a time: one with its tables is tens of kilobytes as such.
_ROWS = 256
#: What a header has besides its tables.
_FRAME = ["image_id", "status", "precision", "width", "height", "num_components", "ss_max_x", "ss_max_y", "restart_interval"]


def headers(images: DataFrame, *, with_content: bool = False) -> DataFrame:
    """OP-02 to OP-17: one row per image; see ``schemas.HEADER``; ``with_content``: and its bytes.

    ``select`` what is needed of ``images`` before: nothing is pruned inside.
    """
    schema, arrow = _arrow(schemas.HEADER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                rows, part = [], b.slice(lo, _ROWS)
                for image_id, data in zip(part.column("image_id").to_pylist(), part.column("content")):
                    h = parse(data.as_py())
                    rows.append(vars(h) | {"image_id": image_id, "num_components": len(h.components)})
                out = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([*out.columns, part.column("content")], names=[*arrow.names, "content"]) if with_content else out

    return images.select("image_id", "content").mapInArrow(run, StructType([*schema.fields, StructField("content", BinaryType())]) if with_content else schema)


def frames(parsed: DataFrame) -> DataFrame:
    """One row per image, without its tables."""
    return parsed.select(*_FRAME)


def frame_rows(images: DataFrame) -> DataFrame:
    """The frames of :func:`headers`, whose tables and scans are checked but never become columns."""
    schema = StructType([f for name in _FRAME for f in StructType.fromDDL(schemas.HEADER).fields if f.name == name])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                parsed = [parse(data.as_py()) for data in part.column("content")]
                of = {"num_components": [len(h.components) for h in parsed]}
                rest = [pa.array(of.get(f.name) or [getattr(h, f.name) for h in parsed], f.type) for f in arrow if f.name != "image_id"]
                yield pa.RecordBatch.from_arrays([part.column("image_id"), *rest], schema=arrow)

    return images.select("image_id", "content").mapInArrow(run, schema)


def markers(parsed: DataFrame) -> DataFrame:
    """OP-03, OP-15, OP-70: all markers of the headers, in order, with their names."""
    from ..operators.lookups import marker_names

    return marker_names(parsed.select("image_id", F.explode("markers").alias("m")).select("image_id", "m.*"))


def components(parsed: DataFrame) -> DataFrame:
    return parsed.select("image_id", F.explode("components").alias("c")).select("image_id", "c.*")


def scans(parsed: DataFrame) -> DataFrame:
    s = parsed.select("image_id", F.explode("scans").alias("s")).select("image_id", "s.*")
    n = F.aggregate("segments", F.lit(0).cast("long"), lambda a, g: a + F.ceil(g["num_bytes"] / SUBSEQUENCE_BYTES))
    return s.select("image_id", "scan_idx", "begin", "end", "num_mcus_x", "num_mcus_y", "units_in_mcu", "restart_interval", F.size("segments").alias("num_segments"), n.cast("int").alias("num_subsequences"))


def _of_scans(parsed: DataFrame, what: str) -> DataFrame:
    s = parsed.select("image_id", F.explode("scans").alias("s"))
    return s.select("image_id", "s.scan_idx", F.explode(f"s.{what}").alias("x")).select("image_id", "scan_idx", "x.*")


def scan_components(parsed: DataFrame) -> DataFrame:
    """OP-13, OP-14."""
    return _of_scans(parsed, "components")


def qtables(parsed: DataFrame) -> DataFrame:
    """OP-11: as they stood when the scan began."""
    return _of_scans(parsed, "qtables")


def huff_tables(parsed: DataFrame) -> DataFrame:
    """OP-09: as they stood when the scan began."""
    return _of_scans(parsed, "huff_tables")


def image_info(parsed: DataFrame) -> DataFrame:
    """What a header query returns: four slots, the unused ones zero."""
    slots = lambda f: F.transform(F.sequence(F.lit(0), F.lit(MAX_COMPONENTS - 1)), lambda k: F.coalesce(F.get("components", k)[f], F.lit(0)))
    return parsed.select("image_id", "status", slots("width").alias("sizes_x"), slots("height").alias("sizes_y"), "num_components", slots("ss_x").alias("ss_x"), slots("ss_y").alias("ss_y"))
