from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import image, table
from pyspark.sql import functions as F

from lumiframe.operators import decode
from lumiframe.operators.huffman import decode_lanes, decode_segment, lookup_table
from lumiframe.operators.reconstruct import reconstruct
from lumiframe.plans.api import RasterCollection
from lumiframe.sinks.png import filtered, png_bytes, unfiltered
from lumiframe.sources.header import parse

CASES = {
    "420": {},
    "444": {"sampling": ((1, 1),) * 3},
    "422": {"sampling": ((2, 1), (1, 1), (1, 1))},
    "440": {"sampling": ((1, 2), (1, 1), (1, 1))},
    "411": {"sampling": ((4, 1), (1, 1), (1, 1)), "width": 70},
    "1x4": {"sampling": ((1, 4), (1, 1), (1, 1)), "height": 50},
    "3x1": {"sampling": ((3, 1), (1, 1), (1, 1)), "width": 50},
    "gray": {"sampling": ((1, 1),)},
    "two": {"sampling": ((2, 1), (1, 1))},
    "four": {"sampling": ((2, 2), (1, 1), (1, 1), (2, 2)), "width": 33},
    "tiny": {"width": 1, "height": 1},
    "restart1": {"restart": 1, "width": 100, "height": 60},
    "restart3": {"restart": 3, "width": 100, "height": 60},
    "restart_row": {"restart": 7, "width": 100, "height": 60},
    "restart_long": {"restart": 999},
    "not_interleaved": {"scans": [[0], [1], [2]], "width": 37, "height": 29},
    "mixed_scans": {"scans": [[0], [1, 2]], "restart": 2, "width": 37, "height": 29},
    "long_codes": {"stairs": True, "width": 60, "height": 40},
    "ids": {"huff_ids": (3, 2)},
    "big_q": {"tables": [[200 + i % 56 for i in range(64)]] * 3},
}


def visible(blocks, sampling, width, height, c):
    """Blocks of component ``c`` that T.81 codes in a scan of its own."""
    mx, my = (max(s[a] for s in sampling) for a in (0, 1))
    x, y = sampling[c]
    return -(-(-(-height * y // my)) // 8), -(-(-(-width * x // mx)) // 8)


def test_coefficients_come_back_exactly(spark):
    made = {k: image(seed=n, **o) for n, (k, o) in enumerate(CASES.items())}
    images = table(spark, {k: v[0] for k, v in made.items()})
    got = RasterCollection(images).coefficients().collect()
    found = {}
    for r in got:
        assert (r.image_id, r.component_idx, r.block_y, r.block_x) not in found
        found[r.image_id, r.component_idx, r.block_y, r.block_x] = list(r.coef)
    for k, (_, blocks, _) in made.items():
        o = {"width": 20, "height": 13, "sampling": ((2, 2), (1, 1), (1, 1))} | CASES[k]
        own = o.get("scans") or [list(range(len(blocks)))]
        alone = {s[0] for s in own if len(s) == 1}
        for c, b in enumerate(blocks):
            rows, columns = visible(blocks, o["sampling"], o["width"], o["height"], c) if c in alone else b.shape[:2]
            for y in range(rows):
                for x in range(columns):
                    assert found.pop((k, c, y, x)) == list(b[y, x]), (k, c, y, x)
    assert not found


def test_planes_and_pixels_agree(spark):
    data, blocks, tables = image(width=37, height=29, restart=2)
    c = RasterCollection(table(spark, {"a": data}), partitions=3)
    planes = {r.component_idx: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in c.planes().collect()}
    assert planes[0].shape == (29, 37) and planes[1].shape == (15, 19)
    for k, p in planes.items():
        px = reconstruct(blocks[k].reshape(-1, 64), np.array(tables[k])).reshape(*blocks[k].shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(blocks[k].shape[0] * 8, -1)
        assert (px[: p.shape[0], : p.shape[1]] == p).all()
    rows = c.pixels().collect()
    assert len(rows) == 29 * 37 + 2 * 15 * 19
    assert all(planes[r.component_idx][r.y, r.x] == r.v for r in rows)


def test_two_images_in_one_partition_do_not_mix(spark):
    a, b = image(seed=1, width=50)[0], image(seed=2, sampling=((1, 1),), huff_ids=(1, 1))[0]
    both = RasterCollection(table(spark, {"a": a, "b": b, "c": a}).coalesce(1)).coefficients()
    n = dict(both.groupBy("image_id").count().collect())
    one = both.where("image_id = 'a'").drop("image_id").exceptAll(both.where("image_id = 'c'").drop("image_id")).count()
    assert n["a"] == n["c"] and one == 0 and n["b"] == 6


def test_jvm_codec_agrees(spark, tmp_path):
    """Another codec on both sides: written by the JVM, decoded by the JVM and here."""
    jvm = spark._jvm
    rng = np.random.default_rng(3)
    made = {}
    for name, kind, (w, h) in (("gray", 10, (40, 29)), ("rgb", 1, (640, 48))):
        img = jvm.java.awt.image.BufferedImage(w, h, kind)
        base = rng.integers(40, 200)
        for y in range(h):
            for x in range(w):
                v = int((base + 2 * x + 3 * y) % 220)
                img.setRGB(x, y, (v << 16) | (((v * 2) % 256 if name == "rgb" else v) << 8) | v)
        f = str(tmp_path / f"{name}.jpg")
        jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(f))
        made[name] = f
    c = RasterCollection.read(spark, str(tmp_path))
    assert [r.status for r in c.frames().collect()] == ["SUCCESS"] * 2
    theirs = {r.image.origin.rsplit("/", 1)[1]: r.image for r in spark.read.format("image").load(str(tmp_path)).collect()}
    ours = {r.image_id.rsplit("/", 1)[1]: r for r in c.rgb().collect()}
    g = np.frombuffer(ours["gray.jpg"].rgb, np.uint8).reshape(29, 40, 3)[:, :, 0].astype(int)
    t = np.frombuffer(bytes(theirs["gray.jpg"].data), np.uint8).reshape(29, 40).astype(int)
    assert ((g - t) ** 2).mean() <= 0.5
    g = np.frombuffer(ours["rgb.jpg"].rgb, np.uint8).reshape(48, 640, 3).astype(int)
    t = np.frombuffer(bytes(theirs["rgb.jpg"].data), np.uint8).reshape(48, 640, 3)[:, :, ::-1].astype(int)
    assert ((g - t) ** 2).mean() < 60  # nearest against smoothed chroma


def test_png_holds_the_pixels(spark, tmp_path):
    import zlib

    data = image(width=21, height=10)[0]
    c = RasterCollection(table(spark, {"a": data, "bad": data[:40]}))
    files = c.write_png(str(tmp_path / "out")).collect()
    assert [r.image_id for r in files] == ["a"]
    raw = (tmp_path / "out" / files[0].file).read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(raw[16:20], "big") == 21
    at = raw.index(b"IDAT")
    size = int.from_bytes(raw[at - 4 : at], "big")
    lines = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), np.uint8).reshape(10, 64)
    assert unfiltered(lines, 3).tobytes() == c.rgb().where("rgb is not null").first().rgb


def test_truncated_data_never_raise(spark):
    data = image(width=30, height=20, restart=2)[0]
    cut = {str(k): data[:k] for k in range(0, len(data), 7)}
    c = RasterCollection(table(spark, cut | {"whole": data}))
    status = dict(c.frames().select("image_id", "status").collect())
    assert status.pop("whole") == "SUCCESS" and "SUCCESS" not in status.values()
    assert c.coefficients().select("image_id").distinct().collect() == [("whole",)]


def test_corrupt_entropy_bits_give_zeros(spark):
    data = bytearray(image(width=60, height=40, stairs=True)[0])
    start = data.index(b"\xff\xda") + 14
    for k in range(start + 20, start + 60):
        data[k] = 0xFE
    n = RasterCollection(table(spark, {"a": bytes(data)})).coefficients().count()
    assert n == RasterCollection(table(spark, {"a": image(width=60, height=40)[0]})).coefficients().count()


def lanes_of(data):
    h = parse(data)
    for s in h.scans:
        tables = {t["slot"]: (tuple(t["counts"]), tuple(t["huffval"])) for t in s["huff_tables"]}
        layout = [(c["component_idx"], tables[2 * c["dc_idx"]], tables[2 * c["ac_idx"] + 1]) for c in s["components"] for _ in range(c["mcu_x"] * c["mcu_y"] // 64)]
        total = s["num_mcus_x"] * s["num_mcus_y"]
        each = s["restart_interval"] or total
        for k, g in enumerate(s["segments"]):
            yield data[g["begin"] : g["end"]].replace(b"\xff\x00", b"\xff"), min(each, total - k * each) * len(layout), layout


@pytest.mark.parametrize("predict", [False, True])
def test_side_by_side_equals_one_by_one(predict):
    """Whole, cut, corrupt and very uneven segments."""
    rng = np.random.default_rng(12)
    lanes = []
    for n, o in enumerate(CASES.values()):
        lanes += lanes_of(image(seed=n, **o)[0])
    lanes += lanes_of(image(width=400, height=300, seed=99)[0])
    for d, u, layout in lanes[:40]:
        lanes.append((d[: len(d) // 2], u, layout))
        noise = bytearray(d)
        for k in rng.integers(0, len(d), 5):
            noise[k] = int(rng.integers(256))
        lanes.append((bytes(noise), u, layout))
    lanes += [(b"", 4, lanes[0][2]), (b"\xff" * 50, 9, lanes[0][2]), (bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), 500, lanes[0][2])]
    got = decode_lanes(lanes, predict=predict)
    for k, (d, u, layout) in enumerate(lanes):
        want = decode_segment(d, u, [(c, lookup_table(*dc), lookup_table(*ac)) for c, dc, ac in layout], predict=predict)
        assert (got[k] == want).all(), k


def test_segments_match_their_bytes(spark):
    data = image(width=100, height=60, restart=3)[0]
    segs = decode.segments(decode.parts(table(spark, {"a": data}))).orderBy("segment_idx").collect()
    at = 0
    for k, s in enumerate(segs):
        assert (s.segment_idx, s.subseq_offset, s.subseq_count) == (k, at, -(-len(s.data) // 128))
        at += s.subseq_count
    assert sum(s.num_mcus for s in segs) == 7 * 4


def test_one_pass_and_grouping_give_the_same(spark):
    """Planes and RGB of images that stay in their task, and of segments that were dealt out."""
    made = {k: image(seed=n, **o)[0] for n, (k, o) in enumerate(CASES.items())} | {"bad": b"x"}
    images = table(spark, made).coalesce(2)
    one, dealt = RasterCollection(images), RasterCollection(images, partitions=3)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(one.planes()) == key(dealt.planes())
    assert key(one.rgb().fillna("")) == key(dealt.rgb().fillna("")) and one.rgb().count() == len(made) - 1
    assert "Exchange" not in one.png()._jdf.queryExecution().executedPlan().toString()


def test_all_tables_can_be_queried_with_sql(spark):
    data = image(width=37, height=29, restart=2)[0]
    c = RasterCollection(table(spark, {"a": data}))
    c.register("all_")
    one = lambda q: spark.sql(q).first()[0]
    assert one("select sum(num_segments) from all_scans") == one("select count(*) from all_segments") == 3
    assert one("select count(*) from all_pixels") == one("select sum(length(data)) from all_planes") == 29 * 37 + 2 * 15 * 19
    assert one("select count(*) from all_huff_codes where len = 4 and class = 0") == 12
    assert one("select count(distinct table_id) from all_qtables") == 3 and one("select count(*) from all_scan_components") == 3
    assert one("select sum(size(counts)) from all_huff_tables") == 32 and one("select length(rgb) from all_rgb") == 3 * 29 * 37
    assert one("select count(*) from all_coefficients") == one("select count(*) from all_pixel_blocks") == one("select units from all_cost")


def test_latency_of_real_decodes(spark):
    from lumiframe.operators.compare import latency_stats

    c = RasterCollection(table(spark, {"a": image(width=60, height=40)[0], "b": image()[0], "bad": b"x"}))
    got = {r.image_id: r for r in c.latency().collect()}
    assert set(got) == {"a", "b"} and all(r.milliseconds > 0 for r in got.values()) and got["a"].samples == 60 * 40 + 2 * 30 * 20
    many = c.latency(iterations=4, warm_up=1).collect()
    assert all(r.iterations == 4 and 0 < r.milliseconds <= r.max_ms <= r.total_ms and abs(r.total_ms - 4 * r.milliseconds) < 1e-6 for r in many) and len(many) == 2
    s = latency_stats(c.latency().withColumn("all", F.lit(1)), ["all"], "milliseconds").first()
    assert s.n == 2 and s.max_ms >= s.avg_ms > 0 and s.per_second > 0


def test_a_path_without_a_scheme_is_on_the_default_file_system(spark, tmp_path):
    from lumiframe.sinks.files import qualified, write_files

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and qualified(spark, "file:///x/y").startswith("file:///x")
    rows = spark.createDataFrame([("a.bin", b"\x00\xff"), ("b.bin", b"")], "file string, content binary")
    assert sorted(r.file for r in write_files(rows, str(tmp_path / "o")).collect()) == ["a.bin", "b.bin"]
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")) == ["a.bin", "b.bin"] and (tmp_path / "o" / "a.bin").read_bytes() == b"\x00\xff"


def test_images_of_one_id_stay_apart(spark):
    """Two images of one id, one after the other and dealt out: six planes and two pictures."""
    a, b = image(seed=1, width=50)[0], image(seed=2, width=50)[0]
    images = spark.createDataFrame([("x", a), ("x", b), (None, a)], "image_id string, content binary").coalesce(1)
    want = {n: [bytes(r.data) for r in RasterCollection(table(spark, {"x": s})).planes().orderBy("component_idx").collect()] for n, s in (("a", a), ("b", b))}
    for c in (RasterCollection(images), RasterCollection(images, partitions=3)):
        got = [(r.image_row, r.component_idx, bytes(r.data)) for r in c.planes().collect()]
        assert len(got) == 9 and sorted(d for _, _, d in got) == sorted(2 * want["a"] + want["b"])
        assert c.rgb().where("rgb is not null").count() == 3


def test_an_interval_set_between_scans_holds_from_there(spark):
    made = {k: image(width=60, height=40, seed=3, scans=[[0], [1, 2]], restart=r) for k, r in {"between": [0, 2], "before": [2, 2], "none": [0, 0]}.items()}
    c = RasterCollection(table(spark, {k: v[0] for k, v in made.items()}))
    assert {(r.image_id, r.scan_idx): r.restart_interval for r in c.scans().collect()} == {("between", 0): 0, ("between", 1): 2, ("before", 0): 2, ("before", 1): 2, ("none", 0): 0, ("none", 1): 0}
    planes = {}
    for r in c.planes().collect():
        planes.setdefault(r.component_idx, set()).add(bytes(r.data))
    assert {k: len(v) for k, v in planes.items()} == {0: 1, 1: 1, 2: 1}


def test_tables_travel_once_a_run(spark):
    """A restart interval of one: rows are about as large as the file, not a hundred times."""
    data = image(width=512, height=512, restart=1)[0]
    runs_ = decode.parts(table(spark, {"a": data})).toPandas()
    assert len(runs_) == 1 and len(runs_.segments[0]) == 32 * 32
    assert decode.segments(decode.parts(table(spark, {"a": data}))).count() == 32 * 32
    cut = decode.parts(table(spark, {"b": image(width=200, height=100, restart=2)[0]}))
    assert cut.count() == 1


def test_runs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decode, "_RUN_BYTES", 600)
    monkeypatch.setattr(decode, "_RUN", 5)
    data = image(width=200, height=100, restart=2)[0]
    got = [r for b in decode.part_step()(iter([pa.RecordBatch.from_pydict({"image_row": [1], "image_id": ["a"], "content": [data]})])) for r in b.to_pylist()]
    assert len(got) > 5 and all(len(r["segments"]) <= 5 and (len(r["segments"]) == 1 or sum(len(g["data"]) for g in r["segments"]) <= 600) for r in got)
    assert [g["segment_idx"] for r in got for g in r["segments"]] == list(range(len(parse(data).scans[0]["segments"])))


@pytest.mark.parametrize("channels", [1, 3])
def test_png_filters_undo(channels):
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (1, 9), (7, 1), (20, 30)):
        noise = rng.integers(0, 256, (h, w * channels), dtype=np.uint8)
        ramp = (np.add.outer(np.arange(h) * 3, np.arange(w * channels) // channels * 2) % 256).astype(np.uint8)
        for lines in (noise, ramp, np.zeros_like(noise), (ramp + noise // 32).astype(np.uint8)):
            made = filtered(lines, channels)
            assert (unfiltered(made, channels) == lines).all()
    kinds = set()
    for kind in range(5):  # lines that each filter is the best for
        made = np.random.default_rng(kind).integers(-1, 2, (12, 1 + 9 * channels)).astype(np.uint8)
        made[:, 0] = kind
        lines = unfiltered(made, channels)
        again = filtered(lines, channels)
        kinds |= set(again[:, 0].tolist())
        assert (unfiltered(again, channels) == lines).all()
    assert kinds == {0, 1, 2, 3, 4}


def test_png_is_smaller_with_filters_and_another_codec_reads_it(spark, tmp_path):
    import zlib

    y, x = np.mgrid[:64, :96]
    rgb = np.stack([(3 * x + y) % 256, (x * y // 40) % 256, (2 * y) % 256], axis=2).astype(np.uint8)
    made = png_bytes(96, 64, rgb.tobytes())
    plain = np.zeros((64, 1 + 96 * 3), np.uint8)
    plain[:, 1:] = rgb.reshape(64, -1)
    assert len(made) < 0.7 * len(zlib.compress(plain.tobytes(), 6))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.png").write_bytes(made)
    (tmp_path / "p" / "g.png").write_bytes(png_bytes(96, 64, rgb[:, :, 0].tobytes(), channels=1))
    theirs = {r.image.origin.rsplit("/", 1)[1]: r.image for r in spark.read.format("image").load(str(tmp_path / "p")).collect()}
    assert (np.frombuffer(bytes(theirs["a.png"].data), np.uint8).reshape(64, 96, 3)[:, :, ::-1] == rgb).all()
    assert (np.frombuffer(bytes(theirs["g.png"].data), np.uint8).reshape(64, 96) == rgb[:, :, 0]).all()


def test_reading_images_leaves_the_session_alone(spark, tmp_path):
    from lumiframe.sources.images import image_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    (tmp_path / "a.jpg").write_bytes(image()[0])
    c = RasterCollection.read(spark, str(tmp_path))
    assert c.frames().count() == 1 and spark.conf.get(key) == before
    with image_batches(spark, 7):
        assert spark.conf.get(key) == "7" and c.planes().count() == 3
    assert spark.conf.get(key) == before


@pytest.mark.slow
def test_forward_dct_is_the_inverse_of_the_inverse(spark):
    """Expressions, numpy and the plain definition agree; decoded samples are as near as the divisors allow."""
    from lumiframe.functions import fixed
    from lumiframe.operators import forward

    rng = np.random.default_rng(0)
    px = np.concatenate([rng.integers(0, 256, (20, 64)), np.zeros((1, 64), int), np.full((1, 64), 255), np.tile([0, 255], (1, 32))])
    for q in ([1] * 64, forward.scaled_table(fixed.LUMA_TABLE, 75), forward.scaled_table(fixed.CHROMA_TABLE, 10)):
        got = forward.forward(px, q)
        rows = spark.createDataFrame([(k, p.tolist(), q) for k, p in enumerate(px)], "k int, px array<bigint>, q array<int>")
        assert {r.k: list(r.coef) for r in forward.quantized_blocks(rows).collect()} == {k: c.tolist() for k, c in enumerate(got)}
        cos = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        plain = np.einsum("ux,nxy,vy->nuv", cos, px.reshape(-1, 8, 8) - 128.0, cos).reshape(-1, 64) / q
        assert np.abs(got - plain).max() <= 0.51
        bound = np.abs(np.einsum("ux,uv,vy->xy", np.abs(cos), np.array(q).reshape(8, 8) / 2.0, np.abs(cos))).max()
        assert np.abs(reconstruct(got, np.array(q)).astype(int) - px).max() <= bound + 3
    assert forward.scaled_table(fixed.LUMA_TABLE, 50) == fixed.LUMA_TABLE and set(forward.scaled_table(fixed.LUMA_TABLE, 100)) == {1} and max(forward.scaled_table(fixed.CHROMA_TABLE, 1)) == 255


@pytest.mark.slow
@pytest.mark.parametrize("sampling", [(1, 1), (2, 2), (2, 1), (1, 4), (3, 2)])
def test_pictures_come_back_from_streams(spark, tmp_path, sampling):
    """Smooth colours to a stream and back; a second codec reads the same picture."""
    from lumiframe.sinks.jpeg import encode_rgb

    y, x = np.mgrid[:45, :70]
    rgb = np.clip(np.stack([60 + x * 2, 200 - y * 3, 90 + x + y], axis=2), 0, 255).astype(np.uint8)
    images = spark.createDataFrame([("a", 70, 45, 3, rgb.tobytes()), ("g", 70, 45, 1, np.repeat(rgb[:, :, :1], 3, axis=2).tobytes()), ("none", 1, 1, 3, None)], "image_id string, width int, height int, num_components int, rgb binary")
    made = encode_rgb(images, quality=95, sampling=sampling, restart=3)
    streams = {r.image_id: r for r in made.collect()}
    assert streams["none"].content is None and streams["a"].length == len(streams["a"].content)
    c = RasterCollection(made.where("content is not null"))
    got = {r.image_id: np.frombuffer(r.rgb, np.uint8).reshape(45, 70, 3).astype(int) for r in c.rgb().collect()}
    assert {r.image_id: r.num_components for r in c.frames().collect()} == {"a": 3, "g": 1}
    assert ((got["a"] - rgb) ** 2).mean() < (3 if sampling == (1, 1) else 25) and np.abs(got["g"][:, :, 0] - rgb[:, :, 0]).max() <= 4
    (tmp_path / "a.jpg").write_bytes(streams["a"].content)
    theirs = spark.read.format("image").load(str(tmp_path)).first().image
    t = np.frombuffer(bytes(theirs.data), np.uint8).reshape(45, 70, 3)[:, :, ::-1].astype(int)
    assert ((t - got["a"]) ** 2).mean() < 25
    with pytest.raises(ValueError, match="luma samples"):
        encode_rgb(images, sampling=(4, 4))


def test_table_functions_in_sql(spark):
    from lumiframe.plans import functions

    functions.register(spark)
    made = {"a": image(width=37, height=29, restart=2)[0], "b": image(scans=[[0], [1, 2]])[0], "bad": b"xx", "none": None}
    images = table(spark, made)
    c = RasterCollection(images)
    images.createOrReplaceTempView("some_images")
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    sql = lambda what, f: spark.sql(f"SELECT i.image_id, {what} FROM some_images i, LATERAL {f}(i.content) t")
    assert rows(sql("t.ord, t.code", "jpeg_markers")) == rows(c.markers().select("image_id", "ord", "code"))
    assert rows(sql("t.status, t.width, t.num_components", "jpeg_frame")) == rows(c.frames().select("image_id", "status", "width", "num_components"))
    assert rows(sql("t.component_idx, t.ss_x, t.height", "jpeg_components")) == rows(c.components().select("image_id", "component_idx", "ss_x", "height"))
    assert rows(sql("t.scan_idx, t.table_id, t.q", "jpeg_qtables")) == rows(c.qtables().select("image_id", "scan_idx", "table_id", "q"))
    assert rows(sql("t.scan_idx, t.slot, t.counts, t.huffval", "jpeg_huff_tables")) == rows(c.huff_tables().select("image_id", "scan_idx", "slot", "counts", "huffval"))
    assert rows(sql("t.scan_idx, t.component_idx, t.dc_idx", "jpeg_scan_components")) == rows(c.scan_components().select("image_id", "scan_idx", "component_idx", "dc_idx"))


@pytest.mark.slow
def test_expressions_decode_the_same_bits(spark):
    """Several components, scans, segments and code lengths; cut and corrupt segments stop where the other decoder stops."""
    from lumiframe.operators import bitwise

    made = {k: image(seed=n, **({"width": 24, "height": 17} | CASES[k]))[0] for n, k in enumerate(["420", "gray", "long_codes", "mixed_scans", "restart1", "ids", "four"])}
    runs_ = decode.parts(table(spark, made))
    rng = np.random.default_rng(0)
    rows = [r.asDict(recursive=True) for r in runs_.collect()]
    broken = []
    for r in rows[:4]:
        for k in range(3):
            own = dict(r, image_id=f"{r['image_id']}-{k}", segments=[dict(g) for g in r["segments"][:2]])
            for g in own["segments"]:
                noise = bytearray(g["data"])
                for at in rng.integers(0, max(len(noise), 1), 4) if noise else []:
                    noise[at] = int(rng.integers(256))
                g["data"] = bytes(noise[: len(noise) // (k + 1)])
            broken.append(own)
    df = spark.createDataFrame(rows + broken, runs_.schema)
    key = lambda d: sorted((r.image_id, r.scan_idx, r.segment_idx, r.unit, tuple(r.coef)) for r in d.select("image_id", "scan_idx", "segment_idx", "unit", "coef").collect())
    mine = bitwise.units(df)
    assert "MapInArrow" not in mine._jdf.queryExecution().executedPlan().toString()
    assert key(mine) == key(decode.units(df))
