from __future__ import annotations

import struct

import pytest
from fixtures import image, table
from pyspark.sql import functions as F

from lumiframe.operators import lookups
from lumiframe.plans.api import RasterCollection
from lumiframe.sources import header

GOOD = image()[0]


def edit(find, at, value, data=GOOD):
    k = data.index(find) + at
    return data[:k] + bytes([value]) + data[k + 1 :]


SOF, SOS, DHT, DQT = b"\xff\xc0", b"\xff\xda", b"\xff\xc4", b"\xff\xdb"
DRI = lambda n: b"\xff\xdd" + struct.pack(">HH", 4, n)

STATUS = {
    "good": (GOOD, "SUCCESS"),
    "null": (None, "INVALID_ARGUMENT"),
    "empty": (b"", "INVALID_JPEG"),
    "not soi": (b"\xff\xd9" + GOOD[2:], "INVALID_JPEG"),
    "not ff": (b"\xfe\xd8" + GOOD[2:], "INVALID_JPEG"),
    "progressive": (edit(SOF, 1, 0xC2), "NOT_SUPPORTED"),
    "extended": (edit(SOF, 1, 0xC1), "SUCCESS"),
    "12 bit": (edit(SOF, 4, 12), "NOT_SUPPORTED"),
    "no height": (edit(SOF, 6, 0, edit(SOF, 5, 0)), "INVALID_JPEG"),
    "five components": (edit(SOF, 9, 5), "NOT_SUPPORTED"),
    "no components": (edit(SOF, 9, 0), "INVALID_JPEG"),
    "sampling 5": (edit(SOF, 11, 0x51), "INVALID_JPEG"),
    "sampling 0": (edit(SOF, 11, 0x02), "INVALID_JPEG"),
    "qtable 4": (edit(SOF, 12, 4), "INVALID_JPEG"),
    "second frame": (GOOD[:2] + GOOD[GOOD.index(SOF) : GOOD.index(SOF) + 19] + GOOD[2:], "INVALID_JPEG"),
    "dht class": (edit(DHT, 4, 0x20), "INVALID_JPEG"),
    "dht id": (edit(DHT, 4, 0x04), "NOT_SUPPORTED"),
    "dht counts": (edit(DHT, 5, 255), "INVALID_JPEG"),
    "dqt 16 bit": (edit(DQT, 4, 0x10), "NOT_SUPPORTED"),
    "dqt id": (edit(DQT, 4, 0x05), "INVALID_JPEG"),
    "restart twice": (image(extra=DRI(2) + DRI(2))[0], "SUCCESS"),
    "restart changed": (image(extra=DRI(2) + DRI(3))[0], "NOT_SUPPORTED"),
    "app and comment": (image(extra=b"\xff\xe0\x00\x04ab\xff\xfe\x00\x03x")[0], "SUCCESS"),
    "short app": (image(extra=b"\xff\xe0\x00\x01")[0], "INVALID_JPEG"),
    "scan of none": (edit(SOS, 4, 0), "INVALID_JPEG"),
    "unknown selector": (edit(SOS, 5, 9), "INVALID_JPEG"),
    "wrong order": (edit(SOS, 7, 1), "INVALID_JPEG"),
    "undefined table": (edit(SOS, 6, 0x11), "INVALID_JPEG"),
    "selector of table 4": (edit(SOS, 6, 0x40), "INVALID_JPEG"),
    "spectral end": (edit(SOS, 12, 20), "NOT_SUPPORTED"),
    "component twice": (image(scans=[[0], [0], [1], [2]])[0], "INVALID_JPEG"),
    "component missing": (image(scans=[[0], [1]])[0], "INVALID_JPEG"),
    "no eoi": (GOOD[:-2], "INVALID_JPEG"),
    "scan before frame": (GOOD[:2] + GOOD[GOOD.index(SOS) :], "INVALID_JPEG"),
    "no frame": (b"\xff\xd8\xff\xd9", "INVALID_JPEG"),
    "eleven units": (image(width=70, height=40, sampling=((4, 2), (2, 1), (1, 1)))[0], "INVALID_JPEG"),
    "eleven units apart": (image(width=70, height=40, sampling=((4, 2), (2, 1), (1, 1)), scans=[[0], [1], [2]])[0], "SUCCESS"),
    "tables after the last scan": (GOOD[:-2] + GOOD[GOOD.index(DHT) : GOOD.index(DHT) + 33] + GOOD[-2:], "SUCCESS"),
    "fill bytes": (GOOD[:2] + b"\xff\xff" + GOOD[2:], "SUCCESS"),
    "cut in app": (b"\xff\xd8\xff\xe0\x00\x20ab", "INCOMPLETE_BITSTREAM"),
    "cut in frame": (GOOD[: GOOD.index(SOF) + 12], "INCOMPLETE_BITSTREAM"),
    "cut in scan header": (GOOD[: GOOD.index(SOS) + 9], "INCOMPLETE_BITSTREAM"),
}


@pytest.mark.parametrize("name", STATUS)
def test_status(name):
    data, status = STATUS[name]
    assert header.parse(data).status == status


def test_every_cut_has_a_status():
    for k in range(len(GOOD)):
        assert header.parse(GOOD[:k]).status in ("INVALID_JPEG", "INCOMPLETE_BITSTREAM")


def test_tables_are_those_at_the_scan():
    """A table redefined between scans holds from then on; one defined once holds for all."""
    data = image(scans=[[0], [1, 2]])[0]
    second = data.index(SOS, data.index(SOS) + 2)
    other = b"\xff\xdb" + struct.pack(">HB", 67, 1) + bytes([9] * 64)
    h = header.parse(data[:second] + other + data[second:])
    assert h.status == "SUCCESS"
    assert [t["table_id"] for t in h.scans[1]["qtables"]] == [1, 2] and h.scans[1]["qtables"][0]["q"] == [9] * 64
    assert len(h.scans[1]["huff_tables"]) == 2


def test_metadata_frames(spark):
    c = RasterCollection(table(spark, {"a": image(width=37, height=29, restart=2)[0], "g": image(sampling=((2, 2),))[0], "bad": b"x"}))
    f = {r.image_id: r for r in c.frames().collect()}
    assert (f["a"].width, f["a"].height, f["a"].ss_max_x, f["a"].restart_interval) == (37, 29, 2, 2)
    assert f["g"].ss_max_x == 1 and f["bad"].message == "invalid jpeg"
    names = [r.name for r in c.markers().where("image_id = 'a'").orderBy("ord").collect()]
    assert names[0] == "Start of image" and names[-1] == "End of image" and "Baseline DCT" in names
    k = {(r.image_id, r.component_idx): (r.width, r.height) for r in c.components().collect()}
    assert k["a", 0] == (37, 29) and k["a", 1] == (19, 15)
    s = c.scans().where("image_id = 'a'").first()
    assert (s.num_mcus_x, s.num_mcus_y, s.units_in_mcu, s.num_segments) == (3, 2, 6, 3)
    info = {r.image_id: r for r in c.image_info().collect()}
    assert info["a"].sizes_x == [37, 19, 19, 0] and not info["a"].is_444 and info["g"].is_444 and not info["bad"].is_444
    assert {r.image_id: r.units for r in c.cost().collect()} == {"a": 36, "g": 6}
    assert lookups.missing_components(c.components(), header.scan_components(c.headers)).count() == 0


def test_metadata_query_prunes_content(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(GOOD)
    c = RasterCollection.read(spark, str(tmp_path))
    plan = c.images.where(F.col("length") > 10).select("image_id")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "GreaterThan(length,10)" in plan


@pytest.mark.parametrize("by_ranges", [False, True])
def test_stream_of_arriving_files(spark, tmp_path, by_ranges):
    from lumiframe.streaming.headers import arrivals_by_status, stream_frames

    (tmp_path / "a.jpg").write_bytes(GOOD)
    (tmp_path / "b.jpg").write_bytes(GOOD[:50])
    name = f"arrived_{by_ranges}"
    q = stream_frames(spark, str(tmp_path), by_ranges=by_ranges).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.image_id.rsplit("/", 1)[1], r.status, r.width) for r in spark.table(name).collect()) == [("a.jpg", "SUCCESS", 20), ("b.jpg", "INVALID_JPEG", 0)]
    counted = arrivals_by_status(spark.table(name).withColumn("modificationTime", F.lit("2026-01-01 10:20:00").cast("timestamp"))).collect()
    assert sorted((r.status, r.n) for r in counted) == [("INVALID_JPEG", 1), ("SUCCESS", 1)]
