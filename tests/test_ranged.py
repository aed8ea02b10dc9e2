"""Headers and segments of files by ranges, against the parser of whole streams."""

from __future__ import annotations

import numpy as np
import pytest
from fixtures import image
from pyspark.sql import functions as F

from lumiframe.operators import dealing
from lumiframe.plans.api import RasterCollection
from lumiframe.sources import ranged
from lumiframe.sources.header import parse

EXIF = b"\xff\xe1" + (60_002).to_bytes(2, "big") + b"\x00\xff\xda\x00" * 15_000


def large(width=3200, height=2400, restart=100, size=4_000_000, seed=0, fill=False):
    """A header with an application segment, and random entropy-coded bytes with restart markers."""
    rng = np.random.default_rng(seed)
    data = image(width=16, height=16, restart=restart, extra=EXIF)[0]
    sof, sos = data.index(b"\xff\xc0"), data.rindex(b"\xff\xda")
    head = bytearray(data[: sos + 14])
    head[sof + 5 : sof + 9] = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    total = -(-width // 16) * -(-height // 16)
    segments = -(-total // restart)
    parts = []
    for k in range(segments):
        raw = rng.integers(0, 256, int(rng.integers(0, 2 * size // segments)), dtype=np.uint8).tobytes().replace(b"\xff", b"\xff\x00")
        parts.append(raw + (b"\xff" * int(rng.integers(1, 4)) if fill else b"\xff") + bytes([0xD0 + k % 8] if k < segments - 1 else [0xD9]))
    return bytes(head) + b"".join(parts) + b"after the end \xff\xd0"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("ranged images")
    streams = {
        "plain.jpg": image(width=60, height=40, extra=EXIF)[0], "scans.jpg": image(width=60, height=40, scans=[[0], [1], [2]], restart=[0, 3, 3])[0], "grey.JPEG": image(sampling=((1, 1),))[0],
        "cut.jpg": image(width=60, height=40)[0][:-2], "short.jpg": image()[0][:60], "other.jpg": b"not an image at all", "empty.jpg": b"", "large.jpg": large(), "fill.jpg": large(size=300_000, seed=1, fill=True), "notes.txt": b"x",
    }
    for name, data in streams.items():
        (at / name).write_bytes(data)
    return at, {k: v for k, v in streams.items() if k != "notes.txt"}


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_headers_equal_the_parsers_and_read_little(spark, folder):
    at, streams = folder
    c = RasterCollection.read_ranged(spark, str(at))
    got = {name_of(r.image_id): r for r in c.headers.collect()}
    assert set(got) == set(streams) - {"empty.jpg"}  # Spark's listing passes over empty files
    for name in got:
        data = streams[name]
        h, r = parse(data), got[name]
        if name != "cut.jpg":  # whole as far as it was read
            assert r.status == h.status, name
        assert (r.width, r.height, r.num_components, r.ss_max_x, r.length) == (h.width, h.height, len(h.components), h.ss_max_x, len(data)), name
        assert [c.asDict() for c in r.components] == h.components
        if h.status == "SUCCESS":
            for mine, theirs in zip(r.scans, h.scans, strict=True):
                assert (mine.begin, mine.num_mcus_x, mine.num_mcus_y, mine.restart_interval) == tuple(theirs[f] for f in ("begin", "num_mcus_x", "num_mcus_y", "restart_interval"))
                assert [q.asDict() for q in mine.qtables] == theirs["qtables"] and [t.asDict() for t in mine.huff_tables] == theirs["huff_tables"]
                assert mine.end in (None, theirs["end"])
        assert r.bytes_read <= len(data)
    assert got["large.jpg"].bytes_read < 0.01 * len(streams["large.jpg"]) and got["large.jpg"].reads <= 4
    assert got["scans.jpg"].scans[0].end == parse(streams["scans.jpg"]).scans[0]["end"]


def test_listing_opens_nothing_and_prunes(spark, folder):
    at, streams = folder
    files = ranged.list_files(spark, str(at)).where("length > 1000000")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(length), GreaterThan(length" in plan
    assert [name_of(r.image_id) for r in ranged.headers(files).collect()] == ["large.jpg"]


def test_as_a_data_source_and_in_sql(spark, folder):
    at, streams = folder
    ranged.register(spark)
    read = lambda t: spark.read.format("jpeg_headers").option("table", t).option("filesPerTask", 2).load(str(at))
    frames = {name_of(r.image_id): (r.status, r.width, r.height) for r in read("frames").collect()}
    assert frames == {k: ("SUCCESS" if h.width and h.components else h.status, h.width, h.height) for k, v in streams.items() for h in [parse(v)]}
    assert read("frames").rdd.getNumPartitions() == -(-len(streams) // 2)
    spark.sql(f"CREATE TEMPORARY VIEW jpeg_components USING jpeg_headers OPTIONS (path '{at}', table 'components')")
    got = spark.sql("SELECT count(*) n, sum(width) w FROM jpeg_components WHERE image_id LIKE '%plain.jpg' AND length > 10").first()
    assert tuple(got) == (3, 60 + 30 + 30)
    spark.sql("DROP VIEW jpeg_components")
    q = parse(streams["grey.JPEG"]).scans[0]["qtables"][0]["q"]
    assert [list(r.q) for r in read("qtables").where("image_id like '%grey.JPEG'").collect()] == [q]
    assert read("huff_tables").where("image_id like '%scans.jpg'").count() == 6
    with pytest.raises(Exception, match="table is one of"):
        read("pixels").collect()


def test_pushed_filters_keep_files_closed(folder):
    from pyspark.sql.datasource import GreaterThan, In, IsNotNull, StringEndsWith

    at, streams = folder
    reader = ranged.HeaderReader(None, {"path": str(at)})
    rest = list(reader.pushFilters([GreaterThan(("length",), 100), StringEndsWith(("image_id",), ".jpg"), IsNotNull(("width",)), In(("width",), (3,))]))
    assert [type(f) for f in rest] == [IsNotNull, In]
    assert {name_of(f) for p in reader.partitions() for f in p.files} == {k for k, v in streams.items() if len(v) > 100 and k.endswith(".jpg")}


@pytest.mark.parametrize("size", [1000, 65_536, 100_000_000])
def test_segments_by_ranges_equal_the_parsers(spark, folder, size):
    at, streams = folder
    some = ranged.list_files(spark, str(at)) if size > 1000 else ranged.list_files(spark, str(at)).where("length < 1000000")
    got = sorted((name_of(r.image_id), r.scan_idx, r.segment_idx, r.begin, r.end, r.num_bytes) for r in ranged.scan_segments(some, size=size, tasks=5).collect())
    want = [(k, s["scan_idx"], *[g[f] for f in ("segment_idx", "begin", "end", "num_bytes")]) for k, v in streams.items() if size > 1000 or len(v) < 1_000_000 for h in [parse(v)] if h.status == "SUCCESS" for s in h.scans for g in s["segments"]]
    assert got == sorted(want) and len(got) > 300


@pytest.mark.slow
def test_cuts_at_every_byte(spark, tmp_path):
    """Markers, stuffed bytes and fill bytes on either side of every cut."""
    data = large(width=100, height=80, restart=2, size=900, seed=5, fill=True)
    (tmp_path / "a.jpg").write_bytes(data)
    files = ranged.list_files(spark, str(tmp_path))
    want = [tuple(g[f] for f in ("segment_idx", "begin", "end", "num_bytes")) for g in parse(data).scans[0]["segments"]]
    for size in (1, 2, 3, 7, 50):
        got = ranged.scan_segments(files, size=size, tasks=3).orderBy("segment_idx").collect()
        assert [(r.segment_idx, r.begin, r.end, r.num_bytes) for r in got] == want, size


@pytest.mark.slow
def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    data = large(width=20_000, height=20_000, restart=50, size=100_000_000, seed=2)
    (tmp_path / "a.jpg").write_bytes(data)
    got = ranged.scan_segments(ranged.list_files(spark, str(tmp_path)), size=4 << 20, tasks=16)
    assert len({r.p for r in got.selectExpr("spark_partition_id() p").collect()}) > 8
    found = got.selectExpr("count(*) n", "sum(num_bytes) b", "sum(begin * (segment_idx % 1000)) x", "sum(end * (segment_idx % 997)) y").first()
    own = parse(data).scans[0]["segments"]
    assert tuple(found) == (len(own), sum(g["num_bytes"] for g in own), sum(g["begin"] * (g["segment_idx"] % 1000) for g in own), sum(g["end"] * (g["segment_idx"] % 997) for g in own))


def test_pixels_by_ranges_equal_those_of_whole_files(spark, folder):
    at, _ = folder
    some = "image_id not like '%large.jpg' and image_id not like '%fill.jpg'"
    whole, parts = RasterCollection.read(spark, str(at)), RasterCollection.read_ranged(spark, str(at), size=100)
    whole.images, parts.images = whole.images.where(some), parts.images.where(some)
    rows = lambda c: sorted((r.image_id, r.component_idx, r.width, r.height, bytes(r.data)) for r in c.planes().collect())
    assert rows(whole) == rows(parts) and len(rows(parts)) == 7
    assert whole.rgb().where("rgb is not null").count() == parts.rgb().where("rgb is not null").count() == 3
    assert parts.frames().where("status = 'SUCCESS'").count() == 4 and parts.components().count() == 10


def test_files_are_dealt_by_cost(spark, tmp_path):
    """One large image among many small ones: its task gets nothing else."""
    for k in range(40):
        (tmp_path / f"s{k}.jpg").write_bytes(image(width=16 + 16 * (k % 5), height=16, seed=k)[0])
    (tmp_path / "big.jpg").write_bytes(image(width=96, height=96)[0])
    c = RasterCollection.read_dealt(spark, str(tmp_path), 4)
    placed = c.images.select(F.spark_partition_id().alias("p"), "image_id").collect()
    units = {r.image_id: r.units for r in c.cost().collect()}
    loads = {}
    for r in placed:
        loads[r.p] = loads.get(r.p, 0) + units[r.image_id]
    assert len(placed) == 41 and len(loads) == 4 and max(loads.values()) <= 1.2 * sum(loads.values()) / 4
    assert c.planes().count() == 41 * 3


@pytest.mark.slow
@pytest.mark.parametrize("tasks", [1, 3, 16])
def test_dealing_is_even(spark, tasks):
    rng = np.random.default_rng(tasks)
    costs = [*np.floor(np.exp(rng.normal(6, 2, 3000))).astype(int).tolist(), *[7] * 2000, 0, 0, None]
    rows = spark.createDataFrame([(str(k % 4990), c) for k, c in enumerate(costs)], "image_id string, cost long")
    for o in ({}, {"rows_per_part": 100, "broadcast_rows": 0}):
        got = dealing.deal(rows, "cost", tasks, **o).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.max("cost").alias("top")).collect()
        assert sum(r.n for r in got) == len(costs) and len(got) == tasks
        total = sum(r.cost for r in got)
        assert max(r.cost for r in got) <= max(1.2 * total / tasks, max(r.top for r in got) * 1.05)
    assert dealing.deal(rows.where("false"), "cost", tasks).count() == 0


def test_filling_by_levels():
    for loads, cost, n in (([0, 0, 0], 2, 7), ([10, 0, 0], 1, 5), ([5, 1, 3], 1, 1), ([0, 0], 0, 9), ([3.5], 0.5, 4), ([100, 1, 1, 1], 10, 3)):
        now = np.array(loads, float)
        quota = dealing.fill(now, cost, n)
        assert quota.sum() == n and (now == np.array(loads) + quota * cost).all()
        touched = quota > 0
        assert cost == 0 or now[touched].max() - cost <= now.min() + 1e-9
