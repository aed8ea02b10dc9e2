"""From images to coefficient blocks: runs of segments as rows, then the entropy decoder over them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.fixed import SUBSEQUENCE_BYTES, SUCCESS
from ..sources.header import Header, parse
from .huffman import decode_all
from .reconstruct import reconstruct

#: Segments that are decoded side by side: at most so many, of so many bytes and units.
_LANES, _BYTES, _UNITS = 2048, 8 << 20, 500_000
#: Blocks of a batch that leaves Python.
_OUT = 65_536
#: A run of segments of one scan, the unit that is dealt to tasks, ends at so many bytes or segments.
_RUN_BYTES, _RUN = 256 << 10, 4096
#: Runs of a batch between two Python passes: each is a hundred times its size as Python objects.
_PART_ROWS = 256
#: A batch of planes ends at so many images or bytes.
_PLANES, _PLANE_BYTES = 256, 4 << 20


#: A step from Arrow batches to Arrow batches; steps made on the driver can be chained in one task.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _arrow(ddl: str) -> tuple[StructType, pa.Schema]:
    schema = StructType.fromDDL(ddl)
    return schema, to_arrow_schema(schema)


def with_row(images: DataFrame) -> DataFrame:
    """(image_row, image_id, content): images are told apart by their row; ids may repeat."""
    return images.select(F.monotonically_increasing_id().alias("image_row"), "image_id", "content")


def scan_facts(h: Header, s: dict) -> dict:
    """What decoding any segment of a scan needs."""
    by_idx = {p["component_idx"]: p for p in h.components}
    mcu, quant = [], []
    for c in s["components"]:
        x, y = c["mcu_x"] // 8, c["mcu_y"] // 8
        p = by_idx[c["component_idx"]]
        mcu += [{"component_idx": c["component_idx"], "x_in": k % x, "y_in": k // x, "ss_x": x, "ss_y": y, "dc_idx": c["dc_idx"], "ac_idx": c["ac_idx"]} for k in range(x * y)]
        quant.append({"component_idx": c["component_idx"], "q": next(q["q"] for q in s["qtables"] if q["table_id"] == p["qtable_idx"]), **{f: p[f] for f in ("width", "height", "ss_x", "ss_y")}})
    return {"scan_idx": s["scan_idx"], "num_mcus_x": s["num_mcus_x"], "mcu": mcu, "huff_tables": s["huff_tables"], "quant": quant}


def _part_rows(image: dict, data: bytes) -> Iterator[dict]:
    h = parse(data)
    if h.status != SUCCESS:
        return
    data = bytes(data)
    for s in h.scans:
        facts = image | scan_facts(h, s)
        total = s["num_mcus_x"] * s["num_mcus_y"]
        each = s["restart_interval"] or total
        at = size = 0
        own: list[dict] = []
        for g in s["segments"]:
            count = -(-g["num_bytes"] // SUBSEQUENCE_BYTES)
            first = g["segment_idx"] * each
            if first < total:
                if own and (size + g["num_bytes"] > _RUN_BYTES or len(own) == _RUN):
                    yield facts | {"segments": own}
                    own, size = [], 0
                own.append({"segment_idx": g["segment_idx"], "subseq_offset": at, "subseq_count": count, "data": data[g["begin"] : g["end"]].replace(b"\xff\x00", b"\xff"), "first_mcu": first, "num_mcus": min(each, total - first)})
                size += g["num_bytes"]
            at += count
        if own:
            yield facts | {"segments": own}


def _runs_of_images(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The runs of segments of each image (image_row, image_id, content), one after another."""
    for b in batches:
        for row, image_id, data in zip(b.column("image_row").to_pylist(), b.column("image_id").to_pylist(), b.column("content")):
            yield from _part_rows({"image_row": row, "image_id": image_id}, data.as_py())


def part_step() -> Step:
    """Batches of images (image_row, image_id, content) to batches of runs of segments, bounded in rows and bytes."""
    arrow = _arrow(schemas.PARTS)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[dict] = []
        size = 0
        for r in _runs_of_images(batches):
            some.append(r)
            size += sum(len(g["data"]) for g in r["segments"])
            if len(some) == _PART_ROWS or size >= _BYTES:
                yield pa.RecordBatch.from_pylist(some, schema=arrow)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return run


def parts(images: DataFrame) -> DataFrame:
    """Runs of restart segments, destuffed, with all that decoding them needs: the layout and tables once a run."""
    return with_row(images).mapInArrow(part_step(), _arrow(schemas.PARTS)[0])


def segments(runs_: DataFrame) -> DataFrame:
    """OP-22, OP-23, OP-33: one row per restart segment."""
    return runs_.select("image_row", "image_id", "scan_idx", "num_mcus_x", F.explode("segments").alias("g")).select("image_row", "image_id", "scan_idx", "num_mcus_x", "g.*")


def spread(runs_: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal runs of segments evenly: for few large images with many restart intervals."""
    keys = ["image_row", "scan_idx", F.col("segments")[0]["segment_idx"]]
    return runs_.repartition(partitions, *keys) if partitions else runs_.repartition(*keys)


@dataclass
class Scan:
    """What is the same in all segments of a run, ready for the decoder."""

    facts: dict

    def __post_init__(self) -> None:
        tables = {t["slot"]: (tuple(t["counts"]), tuple(t["huffval"])) for t in self.facts["huff_tables"]}
        self.layout = [(m["component_idx"], tables[2 * m["dc_idx"]], tables[2 * m["ac_idx"] + 1]) for m in self.facts["mcu"]]
        self.of = {f: np.array([m[f] for m in self.facts["mcu"]]) for f in ("component_idx", "ss_y", "y_in", "ss_x", "x_in")}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, _PART_ROWS):
            yield from b.slice(lo, _PART_ROWS).to_pylist()


def _groups(runs_: Iterator[dict]) -> Iterator[list[tuple[dict, Scan]]]:
    """Segments with their scans, gathered over runs up to the bounds of one decoding."""
    rows: list[tuple[dict, Scan]] = []
    size = units = 0
    for r in runs_:
        scan = Scan(r)
        for g in r.pop("segments"):
            rows.append((g, scan))
            size += len(g["data"])
            units += g["num_mcus"] * len(scan.layout)
            if len(rows) == _LANES or size >= _BYTES or units >= _UNITS:
                yield rows
                rows, size, units = [], 0, 0
    if rows:
        yield rows


def _decoded(runs_: Iterator[dict], predict: bool) -> Iterator[tuple[list[tuple[dict, Scan]], np.ndarray, dict[str, np.ndarray]]]:
    """Groups of segments, their blocks in one array, and of each block: its segment, component, place and unit (OP-52)."""
    for rows in _groups(runs_):
        coef = decode_all([(g["data"], g["num_mcus"] * len(s.layout), s.layout) for g, s in rows], predict=predict)
        at: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "component", "y", "x", "unit")}
        for k, (g, s) in enumerate(rows):
            n = len(s.layout)
            i = np.arange(g["num_mcus"] * n)
            in_mcu, mcu = i % n, g["first_mcu"] + i // n
            at["row"].append(np.full(len(i), k))
            at["component"].append(s.of["component_idx"][in_mcu])
            at["y"].append(mcu // s.facts["num_mcus_x"] * s.of["ss_y"][in_mcu] + s.of["y_in"][in_mcu])
            at["x"].append(mcu % s.facts["num_mcus_x"] * s.of["ss_x"][in_mcu] + s.of["x_in"][in_mcu])
            at["unit"].append(g["first_mcu"] * n + i)
        yield rows, coef, {k: np.concatenate(v) for k, v in at.items()}


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _of_scan(rows: list[tuple[dict, Scan]], field: str, index: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([s.facts[field] for _, s in rows], kind).take(pa.array(index))


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, _OUT):
            yield b.slice(lo, _OUT)


def units(runs_: DataFrame, *, predict: bool = True) -> DataFrame:
    """OP-39, OP-44, OP-45: decoded units in stream order, with their blocks' places."""
    schema = StructType.fromDDL(schemas.UNITS)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, coef, at in _decoded(_rows(batches), predict):
            segment = pa.array([g["segment_idx"] for g, _ in rows], pa.int32()).take(pa.array(at["row"]))
            yield pa.RecordBatch.from_arrays(
                [_of_scan(rows, "image_id", at["row"], pa.string()), _of_scan(rows, "scan_idx", at["row"], pa.int32()), pa.array(at["unit"], pa.int64()), segment, *[pa.array(at[k], pa.int32()) for k in ("component", "y", "x")], _lists(coef, pa.int16())],
                names=names,
            )

    return runs_.mapInArrow(lambda batches: _in_parts(run(batches)), schema)


def coefficient_blocks(runs_: DataFrame) -> DataFrame:
    """OP-53: quantised coefficients by component and block, of all scans."""
    return units(runs_).select("image_id", "component_idx", "block_y", "block_x", "coef")


def _pixels(coef: np.ndarray, tables: list[tuple], kind: np.ndarray) -> np.ndarray:
    """Blocks to samples, table by table; ``kind``: the number of each block's table.  Images often share their tables."""
    own = {t: k for k, t in enumerate(dict.fromkeys(tables))}
    if len(own) == 1:
        return reconstruct(coef, np.array(tables[0]))
    out, number = np.empty(coef.shape, np.int16), np.array([own[t] for t in tables])[kind]
    for t, k in own.items():
        at = np.flatnonzero(number == k)
        out[at] = reconstruct(coef[at], np.array(t))
    return out


def pixel_step(*, of_images: bool = False) -> Step:
    """Batches of runs of segments to batches of pixel blocks; the blocks of an image follow each other as its segments do.

    ``of_images``: from batches of images, whose runs then never become a table.
    """
    rows_of = _runs_of_images if of_images else _rows
    names = [f.name for f in _arrow(schemas.PIXEL_BLOCKS)[0].fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, coef, at in _decoded(rows_of(batches), True):
            # the table and size of each (scan, component), by number
            scans = list({id(s): s for _, s in rows}.values())
            place = {id(s): k for k, s in enumerate(scans)}
            of_row = np.array([place[id(s)] for _, s in rows])
            quant = [q for s in scans for q in s.facts["quant"]]
            number = np.zeros((len(scans), 1 + max(q["component_idx"] for q in quant)), np.int64)
            for n, (k, c) in enumerate((k, q["component_idx"]) for k, s in enumerate(scans) for q in s.facts["quant"]):
                number[k, c] = n
            kind = number[of_row[at["row"]], at["component"]]
            px = _pixels(coef, [tuple(q["q"]) for q in quant], kind)
            size = lambda f: pa.array(np.array([q[f] for q in quant])[kind], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [_of_scan(rows, "image_row", at["row"], pa.int64()), _of_scan(rows, "image_id", at["row"], pa.string()), *[pa.array(at[k], pa.int32()) for k in ("component", "y", "x")], _lists(px, pa.int16()), *map(size, ("width", "height", "ss_x", "ss_y"))],
                names=names,
            )

    return run


def pixel_blocks(runs_: DataFrame) -> DataFrame:
    """OP-39 to OP-57 in one pass over segments: no shuffle between bits and pixels."""
    step = pixel_step()
    return runs_.mapInArrow(lambda batches: _in_parts(step(batches)), _arrow(schemas.PIXEL_BLOCKS)[0])


def image_pixel_blocks(images: DataFrame) -> DataFrame:
    """:func:`pixel_blocks` of whole images, with one Python worker a task."""
    step = pixel_step(of_images=True)
    return with_row(images).mapInArrow(lambda batches: _in_parts(step(batches)), _arrow(schemas.PIXEL_BLOCKS)[0])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixel blocks with a byte a sample; blocks that lie wholly in the padding are left out."""
    for b in batches:
        at = {f: b.column(f).to_numpy() for f in ("block_x", "block_y", "width", "height")}
        inside = np.flatnonzero((at["block_x"] * 8 < at["width"]) & (at["block_y"] * 8 < at["height"]))
        px = b.column("px").flatten().to_numpy().reshape(-1, 64)[inside].astype(np.uint8)
        packed = pa.Array.from_buffers(pa.binary(), len(px), [None, pa.py_buffer(np.arange(len(px) + 1, dtype=np.int32) * 64), pa.py_buffer(np.ascontiguousarray(px))])
        kept = b.take(pa.array(inside))
        yield pa.RecordBatch.from_arrays([packed if n == "px" else kept.column(n) for n in b.schema.names], names=b.schema.names)


def packed_blocks(runs_: DataFrame) -> DataFrame:
    """:func:`pixel_blocks` for a shuffle: ``px`` as 64 bytes, half of what the numbers take."""
    step = pixel_step()
    return runs_.mapInArrow(lambda batches: _pack(_in_parts(step(batches))), schemas.PIXEL_BLOCKS.replace("px array<smallint>", "px binary"))


def _samples(px: pa.ChunkedArray) -> np.ndarray:
    """The samples of blocks, as lists of numbers or packed."""
    if pa.types.is_list(px.type):
        return px.combine_chunks().flatten().to_numpy().astype(np.uint8)
    out = []
    for c in px.chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(out)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each run of rows of one image; a run may go on over batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        image = b.column("image_row").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(image)) + 1).tolist(), len(image)] if len(image) else []
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            if held and held[0].column("image_row")[0] != part.column("image_row")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def image_planes(t: pa.Table) -> list[dict]:
    """The planes of the blocks of one image."""
    out = []
    component, y, x = (t.column(c).to_numpy() for c in ("component_idx", "block_y", "block_x"))
    px = _samples(t.column("px")).reshape(-1, 8, 8)
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        facts = {f: t.column(f)[int(own[0])].as_py() for f in ("width", "height", "ss_x", "ss_y")}
        w, h = facts["width"], facts["height"]
        canvas = np.zeros((int(y[own].max()) + 1, 8, int(x[own].max()) + 1, 8), np.uint8)
        canvas[y[own], :, x[own], :] = px[own]
        part = canvas.reshape(canvas.shape[0] * 8, -1)[:h, :w]
        full = np.zeros((h, w), np.uint8)
        full[: part.shape[0], : part.shape[1]] = part
        out.append({f: t.column(f)[0].as_py() for f in ("image_row", "image_id")} | facts | {"component_idx": int(c), "data": full.tobytes()})
    return out


def plane_step() -> Step:
    """Batches of pixel blocks, an image's one after another, to batches of its planes, of many small images or one large."""
    arrow = _arrow(schemas.PLANES)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[dict] = []
        images = size = 0
        for t in runs(batches):
            made = image_planes(t)
            some += made
            images, size = images + 1, size + sum(len(p["data"]) for p in made)
            if images == _PLANES or size >= _PLANE_BYTES:
                yield pa.RecordBatch.from_pylist(some, schema=arrow)
                some, images, size = [], 0, 0
        if some:
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return run


def timed(images: DataFrame, *, iterations: int = 1, warm_up: int = 0) -> DataFrame:
    """OP-66: each image decoded by itself, ``iterations`` times after ``warm_up`` runs that do not count.

    (image_id, iterations, total_ms, max_ms, milliseconds, samples): ``milliseconds`` is
    the mean.  Rows merge by sums and maxima.  Images that cannot be decoded have none.
    """
    to_pixels = pixel_step(of_images=True)

    def decoded(image: pa.RecordBatch) -> int:
        return sum(len(p["data"]) for t in runs(to_pixels(iter([image]))) for p in image_planes(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                image, took, samples = b.slice(k, 1), [], 0
                for n in range(warm_up + iterations):
                    began = time.perf_counter()
                    samples = decoded(image)
                    if not samples:
                        break
                    if n >= warm_up:
                        took.append(1000 * (time.perf_counter() - began))
                if took:
                    out.append((b.column("image_id")[k].as_py(), len(took), sum(took), max(took), sum(took) / len(took), samples))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], names=["image_id", "iterations", "total_ms", "max_ms", "milliseconds", "samples"])

    return with_row(images).mapInArrow(run, "image_id string, iterations int, total_ms double, max_ms double, milliseconds double, samples long")


def planes(blocks: DataFrame) -> DataFrame:
    """OP-58, OP-69: one row per image and component, cropped, rows packed without padding.

    For blocks, packed or not, in any order: a plane is one value by definition, so its blocks meet
    in one group.  Where an image's blocks follow each other, :func:`plane_step`
    needs no shuffle.
    """
    schema, arrow = _arrow(schemas.PLANES)
    # blocks that lie wholly in the padding never travel
    inside = blocks.where((F.col("block_x") * 8 < F.col("width")) & (F.col("block_y") * 8 < F.col("height")))
    return inside.groupBy("image_row", "image_id", "component_idx").applyInArrow(lambda t: pa.Table.from_pylist(image_planes(t), schema=arrow), schema)
