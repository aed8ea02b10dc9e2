"""Table functions over binary columns, for SQL: ``SELECT .. FROM t, LATERAL jpeg_markers(t.content) m``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.header import parse


class Markers:
    """OP-03: the markers of a stream, in order."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for m in parse(content).markers:
            yield m["ord"], m["offset"], m["code"], m["length"]


class Frame:
    """One row: status and frame."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        h = parse(content)
        yield h.status, h.precision, h.width, h.height, len(h.components), h.restart_interval


class Components:
    """OP-07: the frame's components."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for c in parse(content).components:
            yield tuple(c[f] for f in ("component_idx", "id", "ss_x", "ss_y", "qtable_idx", "width", "height"))


class QuantTables:
    """OP-11: the tables that each scan uses, as they stand when it begins."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for s in parse(content).scans:
            for q in s["qtables"]:
                yield s["scan_idx"], q["table_id"], q["q"]


class HuffTables:
    """OP-09: likewise."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for s in parse(content).scans:
            for t in s["huff_tables"]:
                yield s["scan_idx"], t["class"], t["slot"], t["counts"], t["huffval"]


class ScanComponents:
    """OP-13: the components of each scan."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for s in parse(content).scans:
            for c in s["components"]:
                yield s["scan_idx"], c["sc"], c["component_idx"], c["dc_idx"], c["ac_idx"]


TABLE_FUNCTIONS = {
    "jpeg_markers": (Markers, "ord int, offset bigint, code int, length int"),
    "jpeg_frame": (Frame, "status string, precision int, width int, height int, num_components int, restart_interval int"),
    "jpeg_components": (Components, "component_idx int, id int, ss_x int, ss_y int, qtable_idx int, width int, height int"),
    "jpeg_qtables": (QuantTables, "scan_idx int, table_id int, q array<int>"),
    "jpeg_huff_tables": (HuffTables, "scan_idx int, class int, slot int, counts array<int>, huffval array<int>"),
    "jpeg_scan_components": (ScanComponents, "scan_idx int, sc int, component_idx int, dc_idx int, ac_idx int"),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session; rows travel as Arrow batches."""
    for name, (kind, ddl) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(kind, returnType=ddl, useArrow=True))
