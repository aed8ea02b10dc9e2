"""Files with a commit protocol."""

from __future__ import annotations

import os

import numpy as np
import pytest
from fixtures import image, table
from pyspark.sql import functions as F

from lumiframe.plans.api import RasterCollection
from lumiframe.sinks import raster
from lumiframe.sinks.committed import FilesWriter, Written, save_files


def listed(folder):
    return sorted(f for _, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_a_job_s_files_appear_and_nothing_else(spark, tmp_path):
    rows = spark.range(0, 50, 1, 5).select(F.concat(F.lit("f"), F.col("id")).alias("name"), F.unhex(F.hex("id")).alias("content"), F.lit(1).alias("other"))
    save_files(rows, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == sorted(f"f{k}" for k in range(50)) and os.listdir(tmp_path) == ["out"]
    assert next(p for p in (tmp_path / "out").glob("*/f7")).read_bytes() == b"\x07"
    save_files(rows.where("id < 3").withColumn("name", F.concat(F.lit("g"), "name")), str(tmp_path / "out"))
    assert len(listed(tmp_path / "out")) == 53
    save_files(rows.where("id = 9"), str(tmp_path / "out"), mode="overwrite")
    assert listed(tmp_path / "out") == ["f9"] and os.listdir(tmp_path) == ["out"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id")).alias("name"), F.unhex(F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.hex("id"))).alias("content"))
    with pytest.raises(Exception, match="no"):
        save_files(rows, str(tmp_path / "out"))
    assert listed(tmp_path) == []
    with pytest.raises(Exception, match="no file name"):
        save_files(rows.where("id < 3").withColumn("name", F.lit("../x")), str(tmp_path / "out"))
    assert listed(tmp_path) == []
    with pytest.raises(Exception, match="binary column"):
        save_files(rows.withColumn("content", F.lit(1)), str(tmp_path / "out"))


def test_a_task_that_ran_twice_leaves_one_file(tmp_path):
    writer = FilesWriter({"path": f"file://{tmp_path}/out"}, False)
    folders = []
    for attempt in (1, 2):
        own = tmp_path / f".out.{writer.job}" / f"00000-{attempt}"
        own.mkdir(parents=True)
        (own / "a").write_bytes(b"%d" % attempt)
        folders.append(f"file://{own}")
    writer.commit([Written(0, folders[1], 1), None, Written(2, "unused", 0)])
    assert listed(tmp_path) == ["a"] and next((tmp_path / "out").glob("*/a")).read_bytes() == b"2"


def test_png_files_with_a_commit(spark, tmp_path):
    c = RasterCollection(table(spark, {"a": image()[0], "b": image(seed=2)[0], "bad": b"x"}))
    c.save_png(str(tmp_path / "png"))
    assert len(listed(tmp_path / "png")) == 2
    assert all(next((tmp_path / "png").glob(f"*/{f}")).read_bytes().startswith(b"\x89PNG") for f in listed(tmp_path / "png"))


def pictures():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (1, 2), (3, 7), (5, 8), (4, 300), (2, 513)):
        noise = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        yield noise
        yield np.zeros_like(noise)
        yield np.repeat(noise[:, ::5], 5, axis=1)[:, :w].copy()
        yield noise // 86 * 100


def test_raster_files_come_back():
    for p in pictures():
        h, w = p.shape[:2]
        for kind, read in raster.READERS.items():
            assert read(raster.FORMATS[kind](w, h, p.tobytes())) == (w, h, p.tobytes())
        got = raster.read_hdr(raster.hdr_bytes(w, h, p.tobytes()))
        assert got.shape == p.shape and (np.abs(got - p / 255) <= (p / 255).max(2, keepdims=True) / 128 + 1e-9).all()
    flat = np.full((50, 300, 3), 9, np.uint8).tobytes()
    assert len(raster.tga_bytes(300, 50, flat)) == 18 + 50 * 3 * 4 and len(raster.hdr_bytes(300, 50, flat)) < 2500


def test_another_codec_reads_bmp(spark, tmp_path):
    p = next(x for x in pictures() if x.shape[:2] == (3, 7))
    (tmp_path / "a.bmp").write_bytes(raster.bmp_bytes(7, 3, p.tobytes()))
    theirs = spark.read.format("image").load(str(tmp_path)).first().image
    assert (np.frombuffer(bytes(theirs.data), np.uint8).reshape(3, 7, 3)[:, :, ::-1] == p).all()


def test_raster_files_of_a_collection(spark):
    c = RasterCollection(table(spark, {"a": image()[0], "bad": b"x"}))
    rgb = c.rgb().where("rgb is not null").first().rgb
    for kind in ("bmp", "tga"):
        assert [bytes(r.rgb) for r in raster.decode(c.encoded(kind), kind).collect()] == [bytes(rgb)]
    assert c.encoded("hdr").where("content is not null").count() == 1
