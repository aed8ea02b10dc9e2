from __future__ import annotations

import numpy as np
import pytest
from fixtures import image, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumiframe.functions import expr, fixed
from lumiframe.operators import color, compare, decode, destuff, huffman, reconstruct, scan
from lumiframe.plans import queries
from lumiframe.sinks.jpeg import huffman_rule


def bytes_frame(spark, streams):
    return spark.createDataFrame([(k, 0, p, b) for k, s in streams.items() for p, b in enumerate(s)], "image_id string, scan_idx int, pos long, b int")


def test_windows_agree_with_the_decoder_s_segments(spark):
    """Counts by bytes in windows are those that the parser finds; padded segments hold its bytes."""
    data = image(width=200, height=120, restart=2, seed=5)[0]
    begin = data.index(b"\xff\xda") + 14
    stream = list(data[begin:-2])
    indexed = destuff.segment_index(destuff.byte_flags(bytes_frame(spark, {"a": stream})))
    segs = destuff.segments(indexed)
    dest = destuff.destuffed_bytes(destuff.destuff_offset(indexed), segs)
    ours = {r.segment_idx: r for r in segs.collect()}
    theirs = {r.segment_idx: r for r in decode.segments(decode.parts(table(spark, {"a": data}))).collect()}
    assert len(ours) == len(theirs) > 10
    padded = {r.segment_idx: bytes(r.data) for r in destuff.padded_segments(dest).collect()}
    for k, t in theirs.items():
        assert (ours[k].num_bytes, ours[k].subseq_count, ours[k].subseq_offset) == (len(t.data), t.subseq_count, t.subseq_offset)
        assert padded[k] == bytes(t.data) + bytes(-len(t.data) % 128)
    heads = destuff.subsequence_map(dest).collect()
    assert [r.subseq_idx for r in sorted(heads)] == list(range(sum(t.subseq_count for t in theirs.values())))


def test_long_runs_of_stuffed_bytes(spark):
    stream = [255, 0] * 300 + [255, 208] + [255, 0]
    indexed = destuff.segment_index(destuff.byte_flags(bytes_frame(spark, {"a": stream, "b": [1, 2, 3]})))
    got = {(r.image_id, r.segment_idx): (r.num_bytes, r.subseq_count, r.subseq_offset) for r in destuff.segments(indexed).collect()}
    assert got == {("a", 0): (300, 3, 0), ("a", 1): (1, 1, 3), ("b", 0): (3, 1, 0)}


def test_windows_stay_within_images(spark):
    plan = destuff.destuff_offset(destuff.segment_index(destuff.byte_flags(bytes_frame(spark, {"a": [1]}))))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def stuffed(rng, n, restarts=0.02):
    """Random data bytes, FF stuffed, with restart markers; FFs are frequent."""
    out = []
    for v in rng.choice([255, *range(0, 256, 5)], n):
        out += [255, 0] if v == 255 else [int(v)]
        if rng.random() < restarts:
            out += [255, 208 + int(rng.integers(8))]
    return out


@pytest.mark.slow
@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_chunks_of_any_size_give_what_one_pass_gives(spark, size):
    """Restarts, stuffed bytes and long segments across the cuts; positions that do not start at 0."""
    rng = np.random.default_rng(size)
    streams = {"a": stuffed(rng, 300), "b": stuffed(rng, 150, 0), "c": stuffed(rng, 40, 0.5), "d": [255, 208, 255, 209, 7], "e": [1]}
    want = {}
    for name, s in streams.items():
        seg = off = 0
        for p, v in enumerate(s):
            after = p > 0 and s[p - 1] == 255
            data, restart = v == 0 if after else v != 255, after and 208 <= v <= 215
            want[name, p + 1000] = (data, 255 if after else v, restart, seg, off)
            off += data
            if restart:
                seg, off = seg + 1, 0
    shifted = bytes_frame(spark, streams).withColumn("pos", F.col("pos") + 1000)
    indexed = destuff.segment_index(destuff.byte_flags(shifted, size=size), size=size)
    placed = destuff.destuff_offset(indexed, size=size)
    got = {(r.image_id, r.pos): (r.is_data, r.value, r.is_restart, r.segment_idx, r.offset) for r in placed.collect()}
    assert got == want
    segs = destuff.segments(indexed, size=size)
    total = 0
    for r in segs.where("image_id = 'a'").orderBy("segment_idx").collect():
        assert r.subseq_offset == total
        total += r.subseq_count
    dest = destuff.destuffed_bytes(placed, segs, size=size)
    heads = destuff.subsequence_map(dest).where("image_id = 'a'").orderBy("subseq_idx").collect()
    assert [r.subseq_idx for r in heads] == list(range(total))
    assert {(r.image_id, r.segment_idx, r.offset): r.b for r in dest.collect()} == {(n, s, o): v for (n, _), (d, v, _, s, o) in want.items() if d}


@pytest.mark.slow
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_sums_in_two_levels(spark, size):
    rng = np.random.default_rng(size)
    rows = [(k, int(p), int(rng.integers(-9, 10))) for k in range(3) for p in rng.choice(200, 60, replace=False)]
    df = spark.createDataFrame(rows, "k int, p long, n int")
    for inclusive in (False, True):
        got = {(r.k, r.p): r.s for r in scan.running_sums(df, ["k"], "p", {"s": F.col("n")}, inclusive=inclusive, size=size).collect()}
        assert got == {(k, p): sum(n for k2, p2, n in rows if k2 == k and (p2 < p or inclusive and p2 == p)) for k, p, _ in rows}
    dc = spark.createDataFrame([("a", 0, u, int(rng.integers(-30000, 30000))) for u in range(50)], "image_id string, component_idx int, unit long, dc long")
    for every in (None, 7):
        one, two = (sorted(map(tuple, reconstruct.dc_integrate(dc, every, size=s).collect())) for s in (10**6, size))
        assert one == two


@pytest.mark.slow
def test_a_stream_of_millions_of_bytes_is_no_single_window(spark):
    n = 3_000_000
    b = spark.range(n).select(F.lit("a").alias("image_id"), F.lit(0).alias("scan_idx"), F.col("id").alias("pos"), F.expr("cast(case when id % 1009 = 5 then 255 when id % 1009 = 6 then if(id % 5 = 0, 208, 0) else id % 255 end as int)").alias("b"))
    placed = destuff.destuff_offset(destuff.segment_index(destuff.byte_flags(b)))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and ("b#" in line or "is_data" in line or "is_restart" in line)]
    assert over_rows and all("chunk#" in line for line in over_rows)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # partitions as they are dealt
    try:
        per = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(key)
    assert len(per) > 1 and max(r["count"] for r in per) < 0.7 * n
    got = placed.selectExpr("max(segment_idx) s", "sum(cast(is_data as int)) d", "max(offset) o").first()
    marks = sum(1 for k in range(6, n, 1009) if k % 5 == 0)
    assert got.s == marks and got.d == n - 2 * marks - (len(range(5, n, 1009)) - marks) and got.o == 5 * 1009 - 2 - 4


def test_codes_are_prefix_free_and_match_the_lookup(spark):
    tables = [huffman_rule(list(range(12)), s) for s in (False, True)] + [([0] * 16, [])]
    rows = huffman.canonical_codes(spark.createDataFrame([(k, c, v) for k, (c, v) in enumerate(tables)], "k int, counts array<int>, huffval array<int>")).collect()
    assert len(rows) == 24
    for k, (c, v) in enumerate(tables[:2]):
        size, value = huffman.lookup_table(tuple(c), tuple(v))
        codes = [format(r.code, f"0{r.len}b") for r in rows if r.k == k]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
        for r in (r for r in rows if r.k == k):
            w = r.code << (16 - r.len)
            assert (size[w], value[w]) == (r.len, r.val)


def test_extend_of_all_codes(spark):
    rows = [(n, c) for n in range(12) for c in range(1 << n)]
    got = spark.createDataFrame(rows, "n int, c long").select("n", "c", expr.extend(F.col("c"), F.col("n")).alias("v")).collect()
    for r in got:
        assert r.v == (0 if r.n == 0 else r.c if r.c >= 1 << (r.n - 1) else r.c - (1 << r.n) + 1)


def test_zigzag_and_back(spark):
    df = spark.createDataFrame([(list(range(64)),)], "a array<int>")
    r = df.select(expr.zigzag_to_natural("a").alias("n"), expr.natural_to_zigzag(expr.zigzag_to_natural("a")).alias("b")).first()
    assert r.b == list(range(64)) and [r.n[p] for p in fixed.NATURAL_ORDER] == list(range(64))


@pytest.mark.parametrize("top", [60, 2000, 32767])
def test_both_transforms_agree_to_the_bit(spark, top):
    rng = np.random.default_rng(top)
    coef = rng.integers(-top, top + 1, (60, 64))
    q = rng.integers(1, 256, 64)
    df = spark.createDataFrame([(k, c.tolist(), q.tolist()) for k, c in enumerate(coef)], "k int, c array<smallint>, q array<int>")
    got = reconstruct.idct(df.select("k", expr.dequantize_array(F.col("c"), F.col("q")).alias("coef"))).collect()
    want = reconstruct.reconstruct(coef, q)
    assert all(r.px == want[r.k].tolist() for r in got)


def test_transform_is_near_the_real_one():
    rng = np.random.default_rng(1)
    coef = np.zeros((200, 64), np.int64)
    coef[:, :20] = rng.integers(-60, 61, (200, 20))
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    real = np.einsum("bkl,kx,ly->bxy", coef.reshape(-1, 8, 8), c, c).reshape(-1, 64)
    assert np.abs(reconstruct.reconstruct(coef, np.ones(64, np.int64)) - np.clip(np.round(real) + 128, 0, 255)).max() <= 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.sampled_from([((1, 1),), ((2, 2), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1)), ((4, 1), (1, 1), (1, 1))]), st.integers(0, 5), st.booleans(), st.integers(0, 999))
def test_any_blocks_come_back(width, height, sampling, restart, stairs, seed):
    """Encoder and entropy decoder are inverse, for any size, sampling and restart interval."""
    from lumiframe.sources.header import parse

    data, blocks, _ = image(width, height, sampling, seed=seed, restart=restart, stairs=stairs)
    h = parse(data)
    assert h.status == "SUCCESS"
    (s,) = h.scans
    tables = {t["slot"]: huffman.lookup_table(tuple(t["counts"]), tuple(t["huffval"])) for t in s["huff_tables"]}
    layout = [(c["component_idx"], tables[0], tables[1]) for c in s["components"] for _ in range(c["mcu_x"] * c["mcu_y"] // 64)]
    total = s["num_mcus_x"] * s["num_mcus_y"]
    each = restart or total
    got = np.concatenate([huffman.decode_segment(data[g["begin"] : g["end"]].replace(b"\xff\x00", b"\xff"), min(each, total - k * each) * len(layout), layout) for k, g in enumerate(s["segments"])])
    at = 0
    for m in range(total):
        for c in s["components"]:
            x, y = c["mcu_x"] // 8, c["mcu_y"] // 8
            for i in range(x * y):
                b = blocks[c["component_idx"]][m // s["num_mcus_x"] * y + i // x, m % s["num_mcus_x"] * x + i % x]
                assert (got[at] == b).all()
                at += 1


def test_relational_stages_equal_the_fused_decoder(spark):
    """units (differences) -> dc_integrate -> deinterleave -> dequantize -> idct, against pixel_blocks."""
    data, _, tables = image(width=50, height=40, restart=2, seed=9)
    segs = decode.parts(table(spark, {"a": data}))
    raw = decode.units(segs, predict=False)
    comp = spark.createDataFrame([("a", 0, c, c, 2 if c == 0 else 1, 2 if c == 0 else 1) for c in range(3)], "image_id string, scan_idx int, sc int, component_idx int, ss_x int, ss_y int")
    scans = spark.createDataFrame([("a", 0, 4, 6)], "image_id string, scan_idx int, num_mcus_x int, units_in_mcu int")
    own = F.when(F.col("component_idx") == 0, 4).otherwise(1)
    first = F.when(F.col("component_idx") == 0, 0).otherwise(3 + F.col("component_idx"))
    dc = raw.select("image_id", "component_idx", (expr.idiv(F.col("unit"), 6) * own + F.col("unit") % 6 - first).alias("unit"), F.get("coef", F.lit(0)).alias("dc"), F.col("unit").alias("u"))
    summed = reconstruct.dc_integrate(dc, 2 * own).select(F.col("u").alias("unit"), "dc")
    whole = raw.join(summed, "unit").select("image_id", "scan_idx", "unit", F.transform("coef", lambda v, i: F.when(i == 0, F.col("dc")).otherwise(v.cast("bigint"))).alias("coef"))
    placed = reconstruct.deinterleave(whole, reconstruct.mcu_layout(comp), scans)
    q = spark.createDataFrame([(c, tables[c]) for c in range(3)], "component_idx int, q array<int>")
    got = {(r.component_idx, r.block_y, r.block_x): r.px for r in reconstruct.idct(reconstruct.dequantize(placed, q, ["component_idx"])).collect()}
    want = {(r.component_idx, r.block_y, r.block_x): r.px for r in decode.pixel_blocks(segs).collect()}
    assert got == want and len(got) == 12 * 6


def test_colour_by_join_equals_colour_by_image(spark):
    from lumiframe.plans.api import RasterCollection

    made = {"a": ((2, 2), 1, 1), "b": ((3, 1), 1, 1), "c": ((3, 1), 2, 1), "d": ((1, 4), 1, 1), "e": ((4, 1), 1, 1), "f": ((1, 3), 1, 2), "g": ((1, 1), 1, 1)}
    c = RasterCollection(table(spark, {k: image(width=33, height=21, sampling=(luma, (x, y), (x, y)), seed=n)[0] for n, (k, (luma, x, y)) in enumerate(made.items())}))
    factors = spark.createDataFrame([(k, *luma, x, y) for k, (luma, x, y) in made.items()], "image_id string, luma_x int, luma_y int, chroma_x int, chroma_y int")
    rows = color.to_rgb(color.upsample(c.pixel_blocks(), factors)).collect()
    whole = {r.image_id: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in c.rgb().collect()}
    assert len({(x.image_id, x.y, x.x) for x in rows}) == len(rows) == 33 * 21 * len(made)
    assert all(tuple(whole[x.image_id][x.y, x.x]) == (x.r, x.g, x.b) for x in rows)


def test_colour_tables_equal_the_formula():
    """All pairs of chroma samples, at several luma values."""
    cb, cr = (x.astype(np.uint8) for x in np.mgrid[:256, :256])
    for y in (0, 1, 100, 254, 255):
        plane = lambda c, d: {"image_row": 0, "image_id": "a", "component_idx": c, "width": 256, "height": 256, "ss_x": 1, "ss_y": 1, "data": d.astype(np.uint8).tobytes()}
        got = np.frombuffer(color._rgb([plane(0, np.full((256, 256), y)), plane(1, cb), plane(2, cr)])["rgb"], np.uint8).reshape(256, 256, 3)
        b, r = cb.astype(float) - 128, cr.astype(float) - 128
        c = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
        assert (got == np.clip(np.floor(np.abs(c) + 0.5) * np.sign(c), 0, 255)).all()


@pytest.mark.parametrize("luma,chroma", [((4, 1), (1, 1)), ((3, 1), (1, 1)), ((3, 1), (2, 1)), ((1, 3), (1, 2)), ((1, 4), (1, 1)), ((2, 2), (2, 1)), ((2, 2), (1, 1))])
def test_rgb_of_every_small_size(luma, chroma):
    """Chroma by the factors, not by the ratio of the rounded sizes: planes of ramps, so that a wrong step shows."""
    for w in range(1, 17):
        for h in (1, 2, 5, 8, 9, 16):
            planes = []
            for c, (x, y) in enumerate((luma, chroma, chroma)):
                cw, ch = -(-w * x // max(luma[0], chroma[0])), -(-h * y // max(luma[1], chroma[1]))
                data = (128 + np.add.outer(np.arange(ch), np.arange(cw))).astype(np.uint8) if c else np.full((ch, cw), 100, np.uint8)
                planes.append({"image_row": 0, "image_id": "a", "component_idx": c, "width": cw, "height": ch, "ss_x": x, "ss_y": y, "data": data.tobytes()})
            got = np.frombuffer(color._rgb(planes)["rgb"], np.uint8).reshape(h, w, 3)
            for i in range(h):
                for j in range(w):
                    v = i * chroma[1] // luma[1] + j * chroma[0] // luma[0]
                    assert tuple(got[i, j]) == tuple(int(np.clip(np.floor(t + 0.5), 0, 255)) for t in (100 + 1.402 * v, 100 - 0.344136 * v - 0.714136 * v, 100 + 1.772 * v))


def test_uneven_chroma_is_not_converted(spark):
    from lumiframe.plans.api import RasterCollection

    c = RasterCollection(table(spark, {"odd": image(sampling=((2, 2), (2, 1), (1, 1)))[0], "two": image(sampling=((1, 1), (1, 1)))[0]}))
    assert {r.image_id: r.status for r in c.rgb().collect()} == {"odd": "NOT_SUPPORTED", "two": "NOT_SUPPORTED"}
    assert {r.image_id: r.ok for r in color.convertible(c.components()).collect()} == {"odd": False, "two": False}


def test_comparison_of_two_decodes(spark):
    from lumiframe.plans.api import RasterCollection

    a, b = image(seed=1)[0], image(seed=2)[0]
    x, y = RasterCollection(table(spark, {"i": a})), RasterCollection(table(spark, {"i": b}))
    same = x.mse(x).collect()
    assert len(same) == 3 and all(r.mse == 0 for r in same) and all(r.mse > 0 for r in x.mse(y).collect())
    assert x.structure_diff(y).count() == 0
    z = RasterCollection(table(spark, {"i": image(sampling=((1, 1),))[0]}))
    assert x.structure_diff(z).count() == 3


def test_latency(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 30.0)], "k string, ms double")
    r = compare.latency_stats(df, ["k"], "ms").first()
    assert (r.n, r.avg_ms, r.max_ms, r.per_second) == (2, 20.0, 30.0, 50.0)


def test_wrap_and_clamp_at_the_ends(spark):
    df = spark.createDataFrame([(v,) for v in (-32769, -32768, 32767, 32768, 65536, -1, 256)], "v long")
    got = [tuple(r) for r in df.select(expr.wrap16(F.col("v")), expr.clamp8(F.col("v"))).collect()]
    assert got == [(32767, 0), (-32768, 0), (32767, 255), (-32768, 255), (0, 255), (-1, 0), (256, 255)]


def test_queries_and_sql_have_one_shape(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and queries.FLAGSHIP in names
