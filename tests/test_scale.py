"""What grows with the input in queries over images: Python objects held at a time, tasks, and how often streams are made."""

from __future__ import annotations

import pyarrow as pa
from fixtures import image, table

from lumiframe.operators import decode
from lumiframe.plans import queries
from lumiframe.plans.api import RasterCollection
from lumiframe.sinks import jpeg
from lumiframe.sources import header

SF = "/root/testdata/sf0.001"


class Inner:
    """Stands for a DataFrame: gives the function that would run in the task."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoders_hold_few_rows_at_a_time():
    block = pa.RecordBatch.from_pylist([{"image_id": str(k), "coef": [k % 50] * 64, "q": [1] * 64} for k in range(700)])
    got = list(jpeg.encode_blocks(Inner())(iter([block])))
    assert max(b.num_rows for b in got) <= 128 and sum(b.num_rows for b in got) == 700
    images = pa.RecordBatch.from_pylist([
        {"image_id": str(k), "width": 8, "height": 8, "sampling": [{"x": 1, "y": 1}], "tables": [[1] * 64], "restart": [0], "scans": None, "blocks": [{"component_idx": 0, "block_y": 0, "block_x": 0, "coef": [k % 50] * 64}]} for k in range(700)
    ])
    more = list(jpeg.encode_images(Inner())(iter([images])))
    assert max(b.num_rows for b in more) <= 128
    assert [x for b in more for x in b.column("content").to_pylist()] == [x for b in got for x in b.column("content").to_pylist()]


def test_headers_and_runs_hold_few_rows_at_a_time(spark):
    data = image()[0]
    batch = pa.RecordBatch.from_pydict({"image_row": list(range(600)), "image_id": ["a"] * 600, "content": [data] * 600})
    assert max(b.num_rows for b in header.headers(Inner())(iter([batch]))) <= 256
    assert max(b.num_rows for b in decode.part_step()(iter([batch]))) <= 256


def test_values_that_no_code_has_are_refused():
    import numpy as np
    import pytest

    for at, v in ((0, 65535), (0, 2048), (5, 65537), (5, 1024)):
        z = np.zeros((1, 1, 64), np.int64)
        z[0, 0, at] = v
        with pytest.raises(KeyError):
            jpeg.encode(8, 8, [(1, 1)], [z], [[1] * 64])


def test_bits_to_pixels_is_one_python_pass(spark):
    c = RasterCollection(table(spark, {"a": image()[0]}))
    assert plan(c.pixel_blocks()).count("MapInArrow") == 1


def test_frames_without_tables_equal_those_of_headers(spark):
    streams = {str(k): data for k, (data, _) in enumerate(queries.broken_streams())}
    images = table(spark, streams)
    assert sorted(header.frame_rows(images).collect()) == sorted(header.frames(header.headers(images)).collect())
    assert "scans" not in plan(RasterCollection(images).frames())


def test_images_are_dealt_to_tasks_however_small_their_rows(spark):
    for made in (queries.encoded(spark, SF), queries.collage(spark, SF), queries.samplings(spark, SF)):
        assert made.images.rdd.getNumPartitions() >= 4
    assert "REPARTITION_BY_NUM" in plan(queries.q44(spark, SF))


def test_invariants_make_their_streams_once(spark):
    assert "MapInArrow" not in plan(queries.q56(spark, SF))
