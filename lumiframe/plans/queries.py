"""Queries over the operators, and the same in SQL.

The tables hold no images, so canonical frames are derived from them: ``events``
as a stuffed byte stream, ``embeddings`` as 8x8 blocks of coefficients, ``part``
and ``customer`` as components, sizes and factors.  The operators are those that
decode real images.  Each query reads its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, fixed
from ..operators import bitwise, color, compare, dealing, decode, destuff, forward, huffman, lookups, reconstruct
from ..sinks import files, jpeg, png, raster
from ..sources import header
from . import functions
from .api import RasterCollection

FLAGSHIP = "q17_idct_block"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in as many tasks as the session's shuffles have, or cores: images are work, however few bytes their rows have.

    By bytes alone Spark reads a small table in one task, and joins such partitions again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


# ---------------------------------------------------------------- bytes, from events


def byte_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stuffed stream: FF is always followed by 00 or RSTn; a thousand bytes an image."""
    e = _table(spark, sf, "events")
    b = F.expr(
        "CASE WHEN event_id % 7 = 3 THEN 255 WHEN event_id % 7 = 4 THEN (CASE WHEN event_id % 3 = 0 THEN 208 + (event_id div 7) % 8 ELSE 0 END) ELSE (event_id * 37 + user_id) % 255 END"
    )
    return e.select(F.expr("cast(event_id div 1000 as string)").alias("image_id"), F.lit(0).alias("scan_idx"), F.col("event_id").alias("pos"), b.cast("int").alias("b"))


_BYTES = """
b AS (SELECT CAST(event_id // 1000 AS VARCHAR) AS image_id, event_id AS pos,
      CASE WHEN event_id % 7 = 3 THEN 255 WHEN event_id % 7 = 4 THEN (CASE WHEN event_id % 3 = 0 THEN 208 + (event_id // 7) % 8 ELSE 0 END) ELSE (event_id * 37 + user_id) % 255 END AS b FROM events),
f AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY image_id ORDER BY pos), -1) AS p FROM b),
g AS (SELECT image_id, pos, b, (p = 255 AND b = 0) OR (p <> 255 AND b <> 255) AS is_data, CASE WHEN p = 255 THEN 255 ELSE b END AS value, p = 255 AND b BETWEEN 208 AND 215 AS is_restart FROM f),
r AS (SELECT image_id, pos FROM g WHERE is_restart),
s AS (SELECT g.*, (SELECT count(*) FROM r WHERE r.image_id = g.image_id AND r.pos < g.pos) AS segment_idx FROM g),
d AS (SELECT image_id, segment_idx, pos, value, row_number() OVER (PARTITION BY image_id, segment_idx ORDER BY pos) - 1 AS o FROM s WHERE is_data),
n AS (SELECT image_id, segment_idx, count(*) FILTER (is_data) AS num_bytes FROM s GROUP BY ALL),
c AS (SELECT *, (num_bytes + 127) // 128 AS subseq_count FROM n),
t AS (SELECT c.*, coalesce((SELECT sum(c2.subseq_count) FROM c c2 WHERE c2.image_id = c.image_id AND c2.segment_idx < c.segment_idx), 0) AS subseq_offset FROM c)
"""


def _placed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    indexed = destuff.segment_index(destuff.byte_flags(byte_stream(spark, sf)))
    return destuff.destuff_offset(indexed), destuff.segments(indexed)


@query("q01_byte_flags", f"WITH {_BYTES} SELECT image_id, pos, is_data, CAST(value AS INTEGER) AS value, is_restart FROM g")
def q01(spark, sf):
    return destuff.byte_flags(byte_stream(spark, sf)).select("image_id", "pos", "is_data", "value", "is_restart")


@query("q02_segment_index", f"WITH {_BYTES} SELECT image_id, pos, CAST(segment_idx AS INTEGER) AS segment_idx FROM s")
def q02(spark, sf):
    return destuff.segment_index(destuff.byte_flags(byte_stream(spark, sf))).select("image_id", "pos", "segment_idx")


@query(
    "q03_destuff_offset",
    f"WITH {_BYTES} SELECT s.image_id, s.pos, CAST((SELECT count(*) FROM d WHERE d.image_id = s.image_id AND d.segment_idx = s.segment_idx AND d.pos < s.pos) AS BIGINT) AS \"offset\" FROM s",
)
def q03(spark, sf):
    return _placed(spark, sf)[0].select("image_id", "pos", "offset")


@query("q04_segments", f"WITH {_BYTES} SELECT image_id, CAST(segment_idx AS INTEGER) AS segment_idx, num_bytes, CAST(subseq_count AS BIGINT) AS subseq_count, CAST(subseq_offset AS BIGINT) AS subseq_offset FROM t")
def q04(spark, sf):
    return _placed(spark, sf)[1].select("image_id", "segment_idx", "num_bytes", "subseq_count", "subseq_offset")


@query("q05_subsequence_map", f"WITH {_BYTES} SELECT image_id, CAST(subseq_offset + k AS BIGINT) AS subseq_idx, CAST(segment_idx AS INTEGER) AS segment_idx FROM (SELECT *, unnest(range(subseq_count)) AS k FROM t)")
def q05(spark, sf):
    return destuff.subsequence_map(destuff.destuffed_bytes(*_placed(spark, sf))).select("image_id", "subseq_idx", "segment_idx")


@query("q06_destuffed_bytes", f"WITH {_BYTES} SELECT d.image_id, CAST(d.segment_idx AS INTEGER) AS segment_idx, CAST(subseq_offset * 128 + o AS BIGINT) AS dest, CAST(value AS INTEGER) AS b FROM d JOIN t ON d.image_id = t.image_id AND d.segment_idx = t.segment_idx")
def q06(spark, sf):
    return destuff.destuffed_bytes(*_placed(spark, sf)).select("image_id", "segment_idx", "dest", "b")


@query("q32_padded_segments", f"WITH {_BYTES} SELECT d.image_id, CAST(d.segment_idx AS INTEGER) AS segment_idx, CAST(subseq_count * 128 AS INTEGER) AS size, upper(string_agg(printf('%02x', CAST(value AS INTEGER)), '' ORDER BY o)) || repeat('00', CAST(subseq_count * 128 - count(*) AS INTEGER)) AS bytes FROM d JOIN t ON d.image_id = t.image_id AND d.segment_idx = t.segment_idx GROUP BY d.image_id, d.segment_idx, subseq_count")
def q32(spark, sf):
    return destuff.padded_segments(destuff.destuffed_bytes(*_placed(spark, sf))).select("image_id", "segment_idx", F.length("data").alias("size"), F.hex("data").alias("bytes"))


@query(
    "q07_marker_names",
    """WITH e AS (SELECT 192 + event_id % 64 AS code FROM events),
    n AS (SELECT code, CASE
      WHEN code BETWEEN 208 AND 215 THEN 'Restart with modulo 8 count ' || (code - 208) WHEN code BETWEEN 224 AND 239 THEN 'Application segment ' || (code - 224)
      WHEN code BETWEEN 240 AND 253 THEN 'JPEG extension ' || (code - 240) WHEN code = 254 THEN 'Comment' WHEN code = 192 THEN 'Baseline DCT' WHEN code IN (193, 201) THEN 'Extended sequential DCT'
      WHEN code IN (194, 202) THEN 'Progressive DCT' WHEN code IN (195, 203) THEN 'Lossless (sequential)' WHEN code = 196 THEN 'Define Huffman table(s)' WHEN code IN (197, 205) THEN 'Differential sequential DCT'
      WHEN code IN (198, 206) THEN 'Differential progressive DCT' WHEN code IN (199, 207) THEN 'Differential lossless (sequential)' WHEN code = 200 THEN 'Reserved for JPEG extensions'
      WHEN code = 204 THEN 'Define arithmetic coding conditioning(s)' WHEN code = 216 THEN 'Start of image' WHEN code = 217 THEN 'End of image' WHEN code = 218 THEN 'Start of scan'
      WHEN code = 219 THEN 'Define quantization table(s)' WHEN code = 220 THEN 'Define number of lines' WHEN code = 221 THEN 'Define restart interval' WHEN code = 222 THEN 'Define hierarchical progression'
      WHEN code = 223 THEN 'Expand reference component(s)' ELSE 'unknown marker' END AS name FROM e)
    SELECT CAST(code AS INTEGER) AS code, name, count(*) AS n FROM n GROUP BY ALL""",
)
def q07(spark, sf):
    codes = _table(spark, sf, "events").select((192 + F.col("event_id") % 64).cast("int").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return lookups.marker_names(codes).select("code", "name", "n")


@query(
    "q08_extend",
    """WITH e AS (SELECT event_id, event_id % 12 AS n, event_id * 31 % (1 << (event_id % 12)::INTEGER) AS code FROM events)
    SELECT event_id, CASE WHEN n = 0 THEN 0 WHEN code >= (1 << (n - 1)::INTEGER) THEN code ELSE code - (1 << n::INTEGER) + 1 END::BIGINT AS v FROM e""",
)
def q08(spark, sf):
    e = _table(spark, sf, "events").select("event_id", (F.col("event_id") % 12).alias("n"))
    code = F.col("event_id") * 31 % F.pow(F.lit(2), F.col("n")).cast("bigint")
    return e.select("event_id", expr.extend(code, F.col("n")).alias("v"))


@query(
    "q09_canonical_codes",
    """WITH c(len, n) AS (VALUES (2, 1), (3, 5), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1)),
    s AS (SELECT len, row_number() OVER (ORDER BY len, k) - 1 AS i FROM (SELECT len, unnest(range(n)) AS k FROM c)),
    k AS (SELECT len, i, coalesce(sum(1 << (16 - len)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT n_nationkey, len, CAST(before // (1 << (16 - len)) AS INTEGER) AS code, CAST((i + n_nationkey) % 12 AS INTEGER) AS val FROM k, nation""",
)
def q09(spark, sf):
    counts = F.array(*[F.lit(n) for n in (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)])
    t = _table(spark, sf, "nation").select("n_nationkey", counts.alias("counts"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (i + F.col("n_nationkey")) % 12).alias("huffval"))
    return huffman.canonical_codes(t)


@query(
    "q27_symbol_offsets",
    """SELECT event_id, CAST(coalesce((sum(user_id % 97) OVER (PARTITION BY event_id // 50 ORDER BY event_id)) - user_id % 97, 0) AS BIGINT) AS position FROM events""",
)
def q27(spark, sf):
    e = _table(spark, sf, "events").selectExpr("cast(event_id div 1000 as string) as image_id", "0 as scan_idx", "event_id div 50 as segment_idx", "event_id as subseq", "user_id % 97 as n")
    return destuff.symbol_offsets(e).select(F.col("subseq").alias("event_id"), "position")


# ---------------------------------------------------------------- blocks, from embeddings


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a block of 64 coefficients (a power of two scales it exactly)."""
    e = _table(spark, sf, "embeddings")
    coef = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("bigint"))
    return e.select("vec_id", "label", F.expr("vec_id % 16").alias("block_x"), F.expr("vec_id div 16").alias("block_y"), coef.alias("coef"))


def tables(spark: SparkSession, sf: str) -> DataFrame:
    """A quantisation table for each label."""
    labels = _table(spark, sf, "embeddings").select("label").distinct()
    return labels.select("label", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (1 + (F.col("label") * 7 + i) % 31).cast("smallint")).alias("q"))


_COEF = "u AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(floor(unnest(embedding)::DOUBLE * 1024) AS BIGINT) AS c FROM embeddings)"
_WRAP = "(((({0}) + 32768) & 65535) - 32768)"


def _pass(source: str, group: str, along: str, other: str) -> str:
    """CTEs of one 1-D pass in SQL: pivot eight values, transform, and unpivot."""
    pivot = ", ".join(f"max(CASE WHEN {along} = {k} THEN v END) AS v{k}" for k in range(8))
    outs = ["p0 + p1 + o0", "m0 + m1 + o1", "m0 - m1 + o2", "p0 - p1 + o3", "p0 - p1 - o3", "m0 - m1 - o2", "m0 + m1 - o1", "p0 + p1 - o0"]
    rows = " UNION ALL ".join(f"SELECT {group}, {other}, {k} AS {along}, " + _WRAP.format(f"({o} + 32768) >> 16") + " AS v FROM odd" for k, o in enumerate(outs))
    return f"""(WITH piv AS (SELECT {group}, {other}, {pivot} FROM {source} GROUP BY {group}, {other}),
      mid AS (SELECT *, (v0 + v4) * 23170 AS p0, v2 * 30274 + v6 * 12540 AS p1, (v0 - v4) * 23170 AS m0, v2 * 12540 - v6 * 30274 AS m1,
              ((v3 + v5) * 23170 + 4096) >> 13 AS a, ((v3 - v5) * 23170 + 4096) >> 13 AS b FROM piv),
      odd AS (SELECT *, (v1 * 4 + a) * 8035 + (v7 * 4 + b) * 1598 AS o0, (v1 * 4 - a) * 6811 - (v7 * 4 - b) * 4551 AS o1,
              (v1 * 4 - a) * 4551 + (v7 * 4 - b) * 6811 AS o2, (v1 * 4 + a) * 1598 - (v7 * 4 + b) * 8035 AS o3 FROM mid)
      {rows})"""


_DEQ = f"{_COEF}, x AS (SELECT vec_id, label, i // 8 AS r, i % 8 AS k, {_WRAP.format('c * (1 + (label * 7 + i) % 31)')} AS v FROM u)"
_PIXELS = f"{_DEQ}, y AS {_pass('x', 'vec_id', 'r', 'k')}, z AS {_pass('y', 'vec_id', 'k', 'r')}, px AS (SELECT vec_id, r, k, greatest(0, least(255, {_WRAP.format('v + 128')})) AS px FROM z)"
_PX_SQL = f"WITH {_PIXELS} SELECT vec_id, CAST(sum(px) AS BIGINT) AS px_sum, CAST(min(px) AS BIGINT) AS px_min, CAST(max(px) AS BIGINT) AS px_max, CAST(sum(px * (r * 8 + k + 1)) AS BIGINT) AS px_check FROM px GROUP BY vec_id"


def _px_stats(px: DataFrame) -> DataFrame:
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)
    check = F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return px.select("vec_id", total.alias("px_sum"), F.array_min("px").cast("bigint").alias("px_min"), F.array_max("px").cast("bigint").alias("px_max"), check.alias("px_check"))


@query("q10_zigzag_to_natural", f"""WITH {_COEF}, p AS (SELECT r, c, r + c AS d FROM range(8) a(r), range(8) b(c)),
    z AS (SELECT r * 8 + c AS i, CASE WHEN d < 8 THEN d * (d + 1) // 2 ELSE 64 - (15 - d) * (16 - d) // 2 END + CASE WHEN d % 2 = 0 THEN c ELSE r END - greatest(0, d - 7) AS zz FROM p)
    SELECT vec_id, CAST(z.i AS INTEGER) AS i, c AS v FROM u JOIN z ON u.i = z.zz""")
def q10(spark, sf):
    return blocks(spark, sf).select("vec_id", F.posexplode(expr.zigzag_to_natural("coef")).alias("i", "v"))


_DC = f"{_COEF}, e AS (SELECT vec_id, label, vec_id % 3 AS component_idx, vec_id // 3 AS unit, c * 200 AS dc FROM u WHERE i = 0)"


def _dc_units(spark, sf):
    return blocks(spark, sf).selectExpr("cast(label as string) as image_id", "cast(vec_id % 3 as int) as component_idx", "vec_id div 3 as unit", "coef[0] * 200 as dc", "vec_id")


@query("q11_dc_integrate", f"WITH {_DC} SELECT vec_id, CAST({_WRAP.format('CAST(sum(dc) OVER (PARTITION BY label, component_idx, unit // 24 ORDER BY unit) AS BIGINT)')} AS BIGINT) AS dc FROM e")
def q11(spark, sf):
    return reconstruct.dc_integrate(_dc_units(spark, sf), 24).select("vec_id", "dc")


@query("q12_dc_no_restart", f"WITH {_DC} SELECT vec_id, CAST({_WRAP.format('CAST(sum(dc) OVER (PARTITION BY label, component_idx ORDER BY unit) AS BIGINT)')} AS BIGINT) AS dc FROM e")
def q12(spark, sf):
    return reconstruct.dc_integrate(_dc_units(spark, sf)).select("vec_id", "dc")


@query(
    "q13_unit_address",
    "SELECT event_id, CAST((event_id // (1 + event_id % 4)) * 6 + event_id % 2 + event_id % (1 + event_id % 4) AS BIGINT) AS address FROM events",
)
def q13(spark, sf):
    e = _table(spark, sf, "events").selectExpr("event_id", "event_id as i", "1 + event_id % 4 as units_of_component", "6 as units_in_mcu", "event_id % 2 as first_in_mcu")
    return reconstruct.unit_address(e).select("event_id", "address")


_LAYOUTS = [("0", 1, 1), ("1", 2, 1), ("2", 2, 2), ("3", 4, 1)]


@query(
    "q14_deinterleave",
    """WITH l(image_id, sx, sy) AS (VALUES ('0', 1, 1), ('1', 2, 1), ('2', 2, 2), ('3', 4, 1)),
    e AS (SELECT event_id, l.*, event_id // 4 AS unit, sx * sy + 2 AS n FROM events JOIN l ON l.image_id = CAST(event_id % 4 AS VARCHAR)),
    k AS (SELECT *, unit // n AS mcu, unit % n AS k FROM e)
    SELECT event_id, CAST(greatest(0, k - sx * sy + 1) AS INTEGER) AS component_idx,
      CAST(CASE WHEN k < sx * sy THEN (mcu // 5) * sy + k // sx ELSE mcu // 5 END AS BIGINT) AS block_y,
      CAST(CASE WHEN k < sx * sy THEN (mcu % 5) * sx + k % sx ELSE mcu % 5 END AS BIGINT) AS block_x FROM k""",
)
def q14(spark, sf):
    rows = [(i, 0, c, c, x if c == 0 else 1, y if c == 0 else 1) for i, x, y in _LAYOUTS for c in range(3)]
    parts = spark.createDataFrame(rows, "image_id string, scan_idx int, sc int, component_idx int, ss_x int, ss_y int")
    scans = spark.createDataFrame([(i, 0, 5, x * y + 2) for i, x, y in _LAYOUTS], "image_id string, scan_idx int, num_mcus_x int, units_in_mcu int")
    units = _table(spark, sf, "events").selectExpr("cast(event_id % 4 as string) as image_id", "0 as scan_idx", "event_id div 4 as unit", "event_id")
    return reconstruct.deinterleave(units, reconstruct.mcu_layout(parts), scans).select("event_id", "component_idx", "block_y", "block_x")


@query("q15_dequantize", f"WITH {_DEQ} SELECT vec_id, CAST(r * 8 + k AS INTEGER) AS i, CAST(v AS BIGINT) AS v FROM x")
def q15(spark, sf):
    return reconstruct.dequantize(blocks(spark, sf), tables(spark, sf), ["label"]).select("vec_id", F.posexplode("coef").alias("i", "v"))


@query("q16_idct_1d", f"WITH {_COEF}, x AS (SELECT vec_id, i // 8 AS r, i % 8 AS k, c AS v FROM u), y AS {_pass('x', 'vec_id', 'k', 'r')} SELECT vec_id, CAST(r AS INTEGER) AS r, CAST(k AS INTEGER) AS i, CAST(v AS BIGINT) AS v FROM y")
def q16(spark, sf):
    """The 1-D transform of all eight rows of each block."""
    rows = blocks(spark, sf).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("coef", r * 8 + 1, F.lit(8)))).alias("r", "c"))
    return rows.select("vec_id", "r", F.posexplode(expr.idct_1d("c")).alias("i", "v"))


@query("q17_idct_block", _PX_SQL)
def q17(spark, sf):
    return _px_stats(reconstruct.idct(reconstruct.dequantize(blocks(spark, sf), tables(spark, sf), ["label"])))


@query(
    "q18_crop",
    "SELECT event_id, event_id % 64 AS x, (event_id // 64) % 64 AS y FROM events WHERE event_id % 64 < 1 + user_id % 60 AND (event_id // 64) % 64 < 37",
)
def q18(spark, sf):
    e = _table(spark, sf, "events").selectExpr("event_id", "event_id % 64 as x", "(event_id div 64) % 64 as y", "1 + user_id % 60 as width", "37 as height")
    return reconstruct.crop(e).select("event_id", "x", "y")


# ---------------------------------------------------------------- geometry, from part


def part_components(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Components (three an image) and frames."""
    p = _table(spark, sf, "part").selectExpr(
        "cast(p_partkey div 3 as string) as image_id", "cast(p_partkey % 3 as int) as component_idx", "cast(1 + p_partkey % 4 as int) as ss_x", "cast(1 + (p_partkey div 4) % 4 as int) as ss_y",
        "p_partkey div 3 as g", "p_partkey",
    )
    frames = p.groupBy("image_id").agg(F.max("g").alias("g")).selectExpr("image_id", "100 + g % 900 as width", "50 + g * 3 % 777 as height")
    return p.join(frames, "image_id"), frames


_PART = """c AS (SELECT CAST(p_partkey // 3 AS VARCHAR) AS image_id, CAST(p_partkey % 3 AS INTEGER) AS component_idx, 1 + p_partkey % 4 AS sx, 1 + (p_partkey // 4) % 4 AS sy, p_partkey // 3 AS g FROM part),
f AS (SELECT image_id, max(sx) AS mx, max(sy) AS my, sum(sx * sy) AS u, count(*) AS n, 100 + max(g) % 900 AS w, 50 + max(g) * 3 % 777 AS h FROM c GROUP BY image_id)"""


@query("q19_component_size", f"WITH {_PART} SELECT c.image_id, component_idx, CAST((w * sx + mx - 1) // mx AS BIGINT) AS width, CAST((h * sy + my - 1) // my AS BIGINT) AS height FROM c JOIN f USING (image_id)")
def q19(spark, sf):
    parts, frames = part_components(spark, sf)
    return lookups.component_sizes(parts.select("image_id", "component_idx", "ss_x", "ss_y"), frames).select("image_id", "component_idx", "width", "height")


@query("q20_mcu_geometry", f"WITH {_PART} SELECT image_id, CAST(ceil(w / (8.0 * CASE WHEN n = 1 THEN 1 ELSE mx END)) AS BIGINT) AS num_mcus_x, CAST(ceil(h / (8.0 * CASE WHEN n = 1 THEN 1 ELSE my END)) AS BIGINT) AS num_mcus_y, CAST(CASE WHEN n = 1 THEN 1 ELSE u END AS BIGINT) AS units_in_mcu FROM f")
def q20(spark, sf):
    return lookups.mcu_geometry(*part_components(spark, sf))


@query("q26_missing_components", f"WITH {_PART} SELECT image_id, component_idx FROM c WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.image_id = c.image_id AND s.component_idx = c.component_idx AND (s.g * 3 + s.component_idx) % 5 <> 0)")
def q26(spark, sf):
    parts, _ = part_components(spark, sf)
    return lookups.missing_components(parts, parts.where("p_partkey % 5 <> 0")).select("image_id", "component_idx")


@query(
    "q24_structure_diff",
    f"WITH {_PART}, k AS (SELECT g * 3 + component_idx AS p, c.* FROM c), a AS (SELECT * FROM k WHERE p % 11 <> 0), b AS (SELECT image_id, component_idx, CASE WHEN p % 13 = 0 THEN sx + 1 ELSE sx END AS sx, sy FROM k WHERE p % 17 <> 0) "
    "SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.component_idx, b.component_idx) AS component_idx, CAST(a.sx AS INTEGER) AS a_ss_x, CAST(b.sx AS INTEGER) AS b_ss_x FROM a FULL JOIN b ON a.image_id = b.image_id AND a.component_idx = b.component_idx WHERE a.sx IS DISTINCT FROM b.sx OR a.sy IS DISTINCT FROM b.sy",
)
def q24(spark, sf):
    parts, _ = part_components(spark, sf)
    a = parts.where("p_partkey % 11 <> 0")
    b = parts.where("p_partkey % 17 <> 0").withColumn("ss_x", F.when(F.col("p_partkey") % 13 == 0, F.col("ss_x") + 1).otherwise(F.col("ss_x")))
    return compare.structure_diff(a, b).select("image_id", "component_idx", F.col("a.ss_x").alias("a_ss_x"), F.col("b.ss_x").alias("b_ss_x"))


def _customer_info(spark, sf):
    one = lambda k: F.expr(f"cast(if(c_custkey % {k} = 0, 2, 1) as int)")
    return _table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id"), F.array(one(7), one(11), F.lit(1), F.lit(1)).alias("ss_x"), F.array(one(5), F.lit(1), F.lit(1), one(2)).alias("ss_y"), F.expr("cast(c_custkey % 6 as int)").alias("num_components"))


@query(
    "q21_css_444",
    """SELECT CAST(c_custkey AS VARCHAR) AS image_id, n BETWEEN 1 AND 4 AND c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND (n < 2 OR c_custkey % 11 <> 0) AND (n < 4 OR c_custkey % 2 <> 0) AS is_444
    FROM (SELECT c_custkey, c_custkey % 6 AS n FROM customer)""",
)
def q21(spark, sf):
    return lookups.with_is_444(_customer_info(spark, sf)).select("image_id", "is_444")


@query("q33_same_subsampling", "SELECT CAST(c_custkey AS VARCHAR) AS image_id, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 <> 0 AS same FROM customer")
def q33(spark, sf):
    a = _customer_info(spark, sf)
    ones = F.array(*[F.lit(1)] * 4)
    return lookups.same_subsampling(a, a.select("image_id", ones.alias("ss_x"), ones.alias("ss_y")))


@query(
    "q34_subsampling_names",
    """WITH v(k, css, x, y) AS (VALUES (0, '444', 1, 1), (1, '422', 2, 1), (2, '420', 2, 2), (3, '440', 1, 2), (4, '411', 4, 1), (5, '410', 4, 2), (6, 'gray', 1, 1), (7, '410V', 2, 4), (8, 'none', 0, 0))
    SELECT event_id, css, x AS luma_x, y AS luma_y FROM events JOIN v ON event_id % 9 = k""",
)
def q34(spark, sf):
    names = F.array(*[F.lit(n) for n in ("444", "422", "420", "440", "411", "410", "gray", "410V", "none")])
    e = _table(spark, sf, "events").select("event_id", F.get(names, (F.col("event_id") % 9).cast("int")).alias("css"))
    return lookups.subsampling_factors(e).select("event_id", "css", "luma_x", "luma_y")


# ---------------------------------------------------------------- colour and comparison


def _ycc_blocks(spark, sf):
    """Four vectors an image: luma 16x8 of two, chroma 8x8 of one each; every value is a sample."""
    e = _table(spark, sf, "embeddings")
    px = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 256))).cast("int"))
    part = F.col("vec_id") % 4
    return e.select(
        F.expr("cast(vec_id div 4 as string)").alias("image_id"), F.greatest(F.lit(0), part - 1).cast("int").alias("component_idx"), F.lit(0).alias("block_y"), (part == 1).cast("int").alias("block_x"),
        px.alias("px"), F.when(part < 2, 16).otherwise(8).alias("width"), F.lit(8).alias("height"),
    )


@query(
    "q22_upsample_rgb",
    """WITH u AS (SELECT vec_id // 4 AS g, vec_id % 4 AS part, unnest(range(64)) AS i, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 256))) AS v FROM embeddings),
    l AS (SELECT g, i // 8 AS y, i % 8 + 8 * part AS x, v FROM u WHERE part < 2),
    p AS (SELECT l.g, l.y, l.x, l.v AS cy, b.v - 128 AS cb, r.v - 128 AS cr FROM l JOIN u b ON b.g = l.g AND b.part = 2 AND b.i = l.y * 8 + l.x // 2 JOIN u r ON r.g = l.g AND r.part = 3 AND r.i = b.i)
    SELECT CAST(g AS VARCHAR) AS image_id, y, x, CAST(greatest(0, least(255, round(cy + 1.402::DOUBLE * cr))) AS INTEGER) AS r,
      CAST(greatest(0, least(255, round(cy - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr))) AS INTEGER) AS g, CAST(greatest(0, least(255, round(cy + 1.772::DOUBLE * cb))) AS INTEGER) AS b FROM p""",
)
def q22(spark, sf):
    blocks_ = _ycc_blocks(spark, sf)
    factors = blocks_.where("component_idx = 1").select("image_id", *[F.lit(n).alias(c) for c, n in (("luma_x", 2), ("luma_y", 1), ("chroma_x", 1), ("chroma_y", 1))])
    return color.to_rgb(color.upsample(blocks_, factors))


@query(
    "q35_gray_rgb",
    """SELECT CAST(vec_id AS VARCHAR) AS image_id, i // 8 AS y, i % 8 AS x, v AS r, v AS g, v AS b FROM
    (SELECT vec_id, unnest(range(64)) AS i, CAST(greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 256))) AS INTEGER) AS v FROM embeddings)""",
)
def q35(spark, sf):
    """Each vector as a grey image of its own."""
    e = _table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.5) * 256))).cast("int")
    return color.gray_to_rgb(e.select(F.col("vec_id").cast("string").alias("image_id"), expr.idiv(F.col("i"), 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), v.alias("v")))


@query(
    "q36_convertible",
    f"""WITH {_PART}, s AS (SELECT image_id, count(*) AS n, max(sx) FILTER (component_idx = 0) AS x0, max(sy) FILTER (component_idx = 0) AS y0, max(sx) FILTER (component_idx = 1) AS x1, max(sy) FILTER (component_idx = 1) AS y1,
      max(sx) FILTER (component_idx = 2) AS x2, max(sy) FILTER (component_idx = 2) AS y2 FROM c GROUP BY image_id)
    SELECT image_id, n AS num_components, n = 1 OR (n = 3 AND coalesce(x1 = x2 AND y1 = y2 AND x0 >= x1 AND y0 >= y1, false)) AS ok FROM s""",
)
def q36(spark, sf):
    return color.convertible(part_components(spark, sf)[0].select("image_id", "component_idx", "ss_x", "ss_y"))


@query(
    "q23_mse",
    """WITH u AS (SELECT label, vec_id, unnest(range(64)) AS i, CAST(floor(unnest(embedding)::DOUBLE * 1024) AS BIGINT) AS c FROM embeddings), p AS (SELECT label, greatest(0, least(255, c + 128)) AS a, greatest(0, least(255, (c // 8) * 8 + 128)) AS b FROM (SELECT label, c, c // 8 FROM (SELECT label, c FROM u)))
    SELECT CAST(label AS VARCHAR) AS image_id, CAST(sum((a - b) * (a - b)) AS DOUBLE) / count(*) AS mse FROM p GROUP BY label""",
)
def q23(spark, sf):
    """Each label is an image of one column of blocks."""
    px = lambda f: F.transform("coef", lambda c: F.greatest(F.lit(0), F.least(F.lit(255), f(c) + 128))).alias("px")
    b = blocks(spark, sf).select(F.col("label").cast("string").alias("image_id"), F.lit(0).alias("component_idx"), F.col("vec_id").alias("block_y"), F.lit(0).alias("block_x"), F.lit(8).alias("width"), F.lit(1 << 40).alias("height"), "coef")
    sides = [b.select("image_id", "component_idx", "block_y", "block_x", px(f), "width", "height") for f in (lambda c: c, lambda c: F.call_function("div", c, F.lit(8)) * 8)]
    return compare.block_mse(*sides).select("image_id", "mse")


@query(
    "q25_latency_stats",
    "SELECT event_type, count(value) AS n, round(avg(value), 4) AS avg_ms, round(max(value), 4) AS max_ms, round(count(value) / (sum(value) / 1000), 4) AS per_second FROM events GROUP BY event_type",
)
def q25(spark, sf):
    s = compare.latency_stats(_table(spark, sf, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("avg_ms", "max_ms", "per_second")])


@query(
    "q28_status_text",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'success' WHEN 1 THEN 'invalid argument' WHEN 2 THEN 'invalid jpeg' WHEN 3 THEN 'internal error' WHEN 4 THEN 'jpeg is not supported'
    WHEN 5 THEN 'out of host memory' WHEN 6 THEN 'incomplete bitstream' ELSE 'unknown status' END AS message FROM events""",
)
def q28(spark, sf):
    names = F.array(*[F.lit(n) for n in ("SUCCESS", "INVALID_ARGUMENT", "INVALID_JPEG", "INTERNAL_ERROR", "NOT_SUPPORTED", "OUT_OF_HOST_MEMORY", "INCOMPLETE_BITSTREAM", "?")])
    e = _table(spark, sf, "events").select("event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("status"))
    return lookups.with_status_text(e).select("event_id", "message")


# ---------------------------------------------------------------- whole images, encoded in the query


def encoded(spark: SparkSession, sf: str) -> RasterCollection:
    """Each vector's block as a JPEG stream of its own."""
    b = blocks(spark, sf).join(tables(spark, sf), "label").select(F.col("vec_id").cast("string").alias("image_id"), "coef", "q")
    return RasterCollection(jpeg.encode_blocks(_dealt(b, "image_id")))


@query("q30_decode_e2e", _PX_SQL)
def q30(spark, sf):
    return _px_stats(encoded(spark, sf).pixel_blocks().select(F.col("image_id").cast("bigint").alias("vec_id"), "px"))


@query("q55_decode_by_expressions", _PX_SQL)
def q55(spark, sf):
    """The same bits, decoded by column expressions: codes, coefficients and pixels without Python."""
    units = bitwise.units(decode.parts(encoded(spark, sf).images)).select(F.col("image_id").cast("bigint").alias("vec_id"), "coef")
    divisors = blocks(spark, sf).select("vec_id", "label").join(tables(spark, sf), "label").select("vec_id", "q")
    return _px_stats(reconstruct.idct(reconstruct.dequantize(units, divisors, ["vec_id"])))


@query(
    "q37_mean_luma",
    f"WITH {_PIXELS} SELECT CAST(vec_id AS VARCHAR) AS image_id, CAST(sum(px) AS DOUBLE) / count(*) AS mean_luma FROM px GROUP BY vec_id",
)
def q37(spark, sf):
    return encoded(spark, sf).pixels().groupBy("image_id").agg((F.sum(F.col("v").cast("bigint")) / F.count("*")).alias("mean_luma"))


#: Six kinds of images, by turns: luma factors, MCU columns and rows, components.  All hold 24 blocks.
_KINDS = [(1, 1, 6, 4, 1), (1, 1, 4, 2, 3), (2, 1, 3, 2, 3), (2, 2, 2, 2, 3), (1, 2, 3, 2, 3), (4, 1, 2, 2, 3)]


def collage(spark: SparkSession, sf: str) -> RasterCollection:
    """24 vectors an image: grey, 4:4:4, 4:2:2, 4:2:0, 4:4:0 and 4:1:1, of odd sizes.

    Restart intervals of none to three MCUs; every other run of six images has luma
    and chroma in scans of their own.  Blocks beyond the last vector are zero.
    """
    of = lambda n: F.get(F.array(*[F.lit(k[n]) for k in _KINDS]), (F.col("g") % 6).cast("int"))
    b = blocks(spark, sf).select(F.expr("vec_id div 24").alias("g"), F.expr("cast(vec_id % 24 as int)").alias("unit"), F.transform("coef", lambda c: c.cast("int")).alias("coef"))
    b = b.select("*", of(0).alias("sx"), of(1).alias("sy"), of(2).alias("cx"), of(3).alias("cy"), of(4).alias("components")).withColumn("n", F.expr("sx * sy + components - 1"))
    b = b.selectExpr("*", "unit div n as mcu", "unit % n as k").withColumn("c", F.expr("greatest(0, k - sx * sy + 1)"))
    place = F.expr(
        "named_struct('component_idx', cast(c as int), 'block_y', cast(if(c = 0, mcu div cx * sy + k div sx, mcu div cx) as int), 'block_x', cast(if(c = 0, mcu % cx * sx + k % sx, mcu % cx) as int), 'coef', coef)"
    )
    images = _dealt(b, "g").groupBy("g", "sx", "sy", "cx", "cy", "components").agg(F.collect_list(place).alias("blocks"))
    factors = F.transform(F.sequence(F.lit(0), F.col("components") - 1), lambda c: F.struct(F.when(c == 0, F.col("sx")).otherwise(1).alias("x"), F.when(c == 0, F.col("sy")).otherwise(1).alias("y")))
    tables_ = F.transform(F.sequence(F.lit(0), F.col("components") - 1), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1 + (c * 7 + i) % 31))
    apart = F.array(F.array(F.lit(0)), F.array(F.lit(1), F.lit(2)))
    two = (F.col("components") == 3) & (F.expr("g div 6") % 2 == 1)
    return RasterCollection(jpeg.encode_images(images.select(
        F.col("g").cast("string").alias("image_id"), F.expr("cast(8 * sx * cx - g % 7 as int)").alias("width"), F.expr("cast(8 * sy * cy - g % 5 as int)").alias("height"), factors.alias("sampling"), tables_.alias("tables"),
        F.transform(F.sequence(F.lit(1), F.when(two, 2).otherwise(1)), lambda _: F.expr("cast(g % 4 as int)")).alias("restart"), F.when(two, apart).alias("scans"), "blocks",
    )))


_IMAGES = f"""kinds(kind, sx, sy, cx, cy, components) AS (VALUES {', '.join(str((n, *k)) for n, k in enumerate(_KINDS))}),
im AS (SELECT g, kinds.*, 8 * sx * cx - g % 7 AS w, 8 * sy * cy - g % 5 AS h, g % 4 AS restart, CASE WHEN components = 3 AND (g // 6) % 2 = 1 THEN 2 ELSE 1 END AS scans, sx * sy + components - 1 AS n
  FROM (SELECT DISTINCT vec_id // 24 AS g FROM embeddings) JOIN kinds ON g % 6 = kind),
sc AS (SELECT im.*, 0 AS scan_idx, CASE WHEN scans = 2 THEN sx * cx ELSE cx END AS mx, CASE WHEN scans = 2 THEN sy * cy ELSE cy END AS my, CASE WHEN scans = 2 OR components = 1 THEN 1 ELSE n END AS units FROM im
  UNION ALL SELECT im.*, 1, cx, cy, 2 FROM im WHERE scans = 2),
sg AS (SELECT *, CASE WHEN restart = 0 THEN 1 ELSE (mx * my + restart - 1) // restart END AS segs FROM sc)"""
_IMAGE_PX = f"""{_COEF}, {_IMAGES},
un AS (SELECT im.*, unnest(range(24)) AS unit FROM im),
pl AS (SELECT *, unit // n AS mcu, unit % n AS kk, greatest(0, unit % n - sx * sy + 1) AS comp FROM un),
bl AS (SELECT g, comp, g * 24 + unit AS vec_id, CASE WHEN comp = 0 THEN (mcu // cx) * sy + kk // sx ELSE mcu // cx END AS block_y, CASE WHEN comp = 0 THEN (mcu % cx) * sx + kk % sx ELSE mcu % cx END AS block_x,
  CASE WHEN comp = 0 THEN w ELSE (w + sx - 1) // sx END AS cw, CASE WHEN comp = 0 THEN h ELSE (h + sy - 1) // sy END AS ch, w, h, sx, sy, components FROM pl),
x AS (SELECT u.vec_id, i // 8 AS r, i % 8 AS k, {_WRAP.format('c * (1 + (comp * 7 + i) % 31)')} AS v FROM u JOIN bl USING (vec_id)),
y AS {_pass('x', 'vec_id', 'r', 'k')}, z AS {_pass('y', 'vec_id', 'k', 'r')},
px AS (SELECT vec_id, r, k, greatest(0, least(255, {_WRAP.format('v + 128')})) AS px FROM z),
cells AS (SELECT a.r, b.k FROM range(8) a(r), range(8) b(k)),
bp AS (SELECT bl.*, cells.r, cells.k, coalesce(px, 128) AS px FROM bl CROSS JOIN cells LEFT JOIN px ON px.vec_id = bl.vec_id AND px.r = cells.r AND px.k = cells.k),
sm AS (SELECT g, comp, block_y * 8 + r AS y, block_x * 8 + k AS x, px AS v, cw, ch, sx, sy, w, h, components FROM bp WHERE block_y * 8 + r < ch AND block_x * 8 + k < cw)"""


@query(
    "q29_header_scan",
    f"WITH {_IMAGES} SELECT CAST(g AS VARCHAR) AS image_id, 'SUCCESS' AS status, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, CAST(max(components) AS INTEGER) AS num_components, CAST(max(restart) AS INTEGER) AS restart_interval, "
    "CAST(5 + max(components) + max(CASE WHEN restart > 0 THEN 1 ELSE 0 END) + count(*) AS INTEGER) AS num_markers, CAST(count(*) AS INTEGER) AS num_scans, CAST(sum(segs) AS INTEGER) AS num_segments FROM sg GROUP BY g",
)
def q29(spark, sf):
    segments = F.aggregate("scans", F.lit(0), lambda n, s: n + F.size(s["segments"]))
    return collage(spark, sf).headers.select("image_id", "status", "width", "height", "num_components", "restart_interval", F.size("markers").alias("num_markers"), F.size("scans").alias("num_scans"), segments.alias("num_segments"))


@query(
    "q38_decode_cost",
    f"WITH {_IMAGES} SELECT CAST(g AS VARCHAR) AS image_id, CAST(sum(mx * my * units) AS BIGINT) AS units, CAST(sum(mx * my * units) * 64 AS BIGINT) AS samples FROM sg GROUP BY g",
)
def q38(spark, sf):
    return collage(spark, sf).cost().select("image_id", "units", "samples")


@query(
    "q39_image_blocks",
    f"WITH {_IMAGE_PX} SELECT CAST(g AS VARCHAR) AS image_id, CAST(comp AS INTEGER) AS component_idx, CAST(block_y AS INTEGER) AS block_y, CAST(block_x AS INTEGER) AS block_x, CAST(max(cw) AS INTEGER) AS width, CAST(max(ch) AS INTEGER) AS height, "
    "CAST(sum(px) AS BIGINT) AS px_sum, CAST(sum(px * (r * 8 + k + 1)) AS BIGINT) AS px_check FROM bp GROUP BY ALL",
)
def q39(spark, sf):
    """Bits to pixel blocks: several components, scans and restart segments."""
    zero = F.lit(0).cast("bigint")
    check = F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), zero, lambda a, v: a + v)
    return collage(spark, sf).pixel_blocks().select("image_id", "component_idx", "block_y", "block_x", "width", "height", F.aggregate("px", zero, lambda a, v: a + v).alias("px_sum"), check.alias("px_check"))


@query(
    "q40_planes",
    f"WITH {_IMAGE_PX} SELECT CAST(g AS VARCHAR) AS image_id, CAST(comp AS INTEGER) AS component_idx, CAST(max(cw) AS INTEGER) AS width, CAST(max(ch) AS INTEGER) AS height, CAST(count(*) AS INTEGER) AS samples, "
    "CAST(sum(v * (1 + (y * cw + x) % 997)) AS BIGINT) AS sample_check FROM sm GROUP BY g, comp",
)
def q40(spark, sf):
    """Whole planes, cropped and packed."""
    sample = lambda i: F.conv(F.hex(F.substr("data", i + 1, F.lit(1))), 16, 10).cast("bigint") * (1 + i % 997)
    check = F.aggregate(F.sequence(F.lit(0), F.octet_length("data") - 1), F.lit(0).cast("bigint"), lambda a, i: a + sample(i))
    return collage(spark, sf).planes().select("image_id", "component_idx", "width", "height", F.octet_length("data").alias("samples"), check.alias("sample_check"))


_RGB = f"""WITH {_IMAGE_PX}, l AS (SELECT * FROM sm WHERE comp = 0),
    t AS (SELECT l.g, l.w, l.h, l.y, l.x, CASE WHEN l.components = 1 THEN l.v ELSE greatest(0, least(255, round(l.v + 1.402::DOUBLE * (r.v - 128)))) END AS r,
      CASE WHEN l.components = 1 THEN l.v ELSE greatest(0, least(255, round(l.v - 0.344136::DOUBLE * (b.v - 128) - 0.714136::DOUBLE * (r.v - 128)))) END AS gr,
      CASE WHEN l.components = 1 THEN l.v ELSE greatest(0, least(255, round(l.v + 1.772::DOUBLE * (b.v - 128)))) END AS b
      FROM l LEFT JOIN sm b ON b.g = l.g AND b.comp = 1 AND b.y = l.y // l.sy AND b.x = l.x // l.sx LEFT JOIN sm r ON r.g = l.g AND r.comp = 2 AND r.y = b.y AND r.x = b.x),
    i AS (SELECT *, 3 * (y * w + x) AS i FROM t)"""


@query(
    "q31_png",
    f"""{_RGB}
    SELECT CAST(g AS VARCHAR) AS image_id, true AS is_png, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, CAST(sum(r + gr + b) AS BIGINT) AS rgb_sum,
      CAST(sum(r * (1 + i % 997) + gr * (1 + (i + 1) % 997) + b * (1 + (i + 2) % 997)) AS BIGINT) AS rgb_check FROM i GROUP BY g""",
)
def q31(spark, sf):
    """Bits to PNG files, and the samples that are read back from the files."""
    files = collage(spark, sf).png()
    zero = F.lit(0).cast("bigint")
    check = F.aggregate(F.transform("samples", lambda v, i: v * (1 + i % 997)), zero, lambda a, v: a + v)
    back = png.read_png(files).select("image_id", F.lit(True).alias("is_png"), "width", "height", F.aggregate("samples", zero, lambda a, v: a + v).alias("rgb_sum"), check.alias("rgb_check"))
    return back


#: Factors of luma and of both chroma components, by turns.
_SAMPLINGS = [(1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1), (1, 2, 1, 1), (4, 1, 1, 1), (1, 4, 1, 1), (3, 1, 1, 1), (3, 1, 2, 1), (1, 3, 1, 2), (2, 2, 2, 1), (2, 2, 1, 2)]


def samplings(spark: SparkSession, sf: str) -> RasterCollection:
    """An image for each vector, of 1 to 16 columns and lines, in all samplings; two follow each other under one id.

    Block (component, y, x) is the vector ``8 * component + 4 * y + x`` places on, zero
    beyond the last.  Every third image has luma in a scan of its own, and a restart
    interval that is set only after that scan.
    """
    of = lambda n: F.get(F.array(*[F.lit(k[n]) for k in _SAMPLINGS]), F.expr(f"cast(g % {len(_SAMPLINGS)} as int)"))
    b = blocks(spark, sf).select("vec_id", F.transform("coef", lambda c: c.cast("int")).alias("coef"))
    im = b.select(F.col("vec_id").alias("g"), F.expr("cast(1 + vec_id % 16 as int)").alias("width"), F.expr("cast(1 + vec_id * 7 div 16 % 16 as int)").alias("height")).withColumns({n: of(k) for k, n in enumerate(("sx", "sy", "cx", "cy"))})
    im = im.withColumns({"mx": F.expr("(width + 8 * sx - 1) div (8 * sx)"), "my": F.expr("(height + 8 * sy - 1) div (8 * sy)")})
    places = F.expr(
        "flatten(transform(sequence(0, 2), c -> flatten(transform(sequence(0, my * if(c = 0, sy, cy) - 1), y -> transform(sequence(0, mx * if(c = 0, sx, cx) - 1), x -> struct(c as component_idx, cast(y as int) as block_y, cast(x as int) as block_x))))))"
    )
    each = im.select("*", F.explode(places).alias("p")).withColumn("vec_id", F.expr("g + 8 * p.component_idx + 4 * p.block_y + p.block_x"))
    filled = _dealt(each.join(b, "vec_id"), "g").groupBy("g", "width", "height", "sx", "sy", "cx", "cy").agg(F.collect_list(F.struct("p.component_idx", "p.block_y", "p.block_x", "coef")).alias("blocks"))
    factors = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.struct(F.when(c == 0, F.col("sx")).otherwise(F.col("cx")).alias("x"), F.when(c == 0, F.col("sy")).otherwise(F.col("cy")).alias("y")))
    tables_ = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1 + (c * 7 + i) % 31))
    third = F.col("g") % 3 == 0
    return RasterCollection(jpeg.encode_images(filled.select(
        F.expr("cast(g div 2 as string)").alias("image_id"), "width", "height", factors.alias("sampling"), tables_.alias("tables"), F.when(third, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("restart"),
        F.when(third, F.array(F.array(F.lit(0)), F.array(F.lit(1), F.lit(2)))).alias("scans"), "blocks",
    )))


@query(
    "q46_rgb_samplings",
    f"""WITH {_COEF}, kinds(kind, sx, sy, cx, cy) AS (VALUES {', '.join(str((n, *k)) for n, k in enumerate(_SAMPLINGS))}),
    im AS (SELECT vec_id AS g, 1 + vec_id % 16 AS w, 1 + vec_id * 7 // 16 % 16 AS h, sx, sy, cx, cy FROM embeddings JOIN kinds ON vec_id % {len(_SAMPLINGS)} = kind),
    comps(comp) AS (VALUES (0), (1), (2)),
    x AS (SELECT vec_id, comp * 1000000000 + vec_id AS key, i // 8 AS r, i % 8 AS k, {_WRAP.format('c * (1 + (comp * 7 + i) % 31)')} AS v FROM u CROSS JOIN comps),
    y AS {_pass('x', 'key', 'r', 'k')}, z AS {_pass('y', 'key', 'k', 'r')},
    px AS (SELECT key, r, k, greatest(0, least(255, {_WRAP.format('v + 128')})) AS px FROM z),
    p AS (SELECT im.*, unnest(range(h)) AS y FROM im), q AS (SELECT p.*, unnest(range(w)) AS x FROM p), s AS (SELECT q.*, y * cy // sy AS v, x * cx // sx AS t FROM q),
    m AS (SELECT s.*, coalesce(l.px, 128) AS lum, coalesce(b.px, 128) - 128 AS cb, coalesce(r.px, 128) - 128 AS cr FROM s
      LEFT JOIN px l ON l.key = g + 4 * (y // 8) + x // 8 AND l.r = y % 8 AND l.k = x % 8
      LEFT JOIN px b ON b.key = 1000000000 + g + 8 + 4 * (v // 8) + t // 8 AND b.r = v % 8 AND b.k = t % 8 LEFT JOIN px r ON r.key = 2000000000 + g + 16 + 4 * (v // 8) + t // 8 AND r.r = v % 8 AND r.k = t % 8),
    o AS (SELECT g, w, h, 3 * (y * w + x) AS i, greatest(0, least(255, round(lum + 1.402::DOUBLE * cr))) AS r, greatest(0, least(255, round(lum - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr))) AS gr, greatest(0, least(255, round(lum + 1.772::DOUBLE * cb))) AS b FROM m)
    SELECT CAST(g // 2 AS VARCHAR) AS image_id, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, CAST(sum(r + gr + b) AS BIGINT) AS rgb_sum,
      CAST(sum(r * (1 + i % 997) + gr * (1 + (i + 1) % 997) + b * (1 + (i + 2) % 997)) AS BIGINT) AS rgb_check FROM o GROUP BY g""",
)
def q46(spark, sf):
    """RGB of small images in all samplings: other factors than 2, intervals set between scans, ids that repeat."""
    zero = F.lit(0).cast("bigint")
    rgb = samplings(spark, sf).rgb()
    sample = F.transform(F.sequence(F.lit(0), F.octet_length("rgb") - 1), lambda i: F.conv(F.hex(F.substr("rgb", i + 1, F.lit(1))), 16, 10).cast("bigint"))
    return rgb.select("image_id", "width", "height", sample.alias("s")).select(
        "image_id", "width", "height", F.aggregate("s", zero, lambda a, v: a + v).alias("rgb_sum"), F.aggregate(F.transform("s", lambda v, i: v * (1 + i % 997)), zero, lambda a, v: a + v).alias("rgb_check")
    )


@query(
    "q41_markers",
    f"""WITH {_IMAGES}, m(code, name, place) AS (VALUES (216, 'Start of image', 0), (219, 'Define quantization table(s)', 1), (192, 'Baseline DCT', 2), (196, 'Define Huffman table(s)', 3), (221, 'Define restart interval', 4), (218, 'Start of scan', 5), (217, 'End of image', 6)),
    e AS (SELECT g, m.*, unnest(range(CASE code WHEN 219 THEN components WHEN 196 THEN 2 WHEN 221 THEN CASE WHEN restart > 0 THEN 1 ELSE 0 END WHEN 218 THEN scans ELSE 1 END)) AS k FROM im, m)
    SELECT CAST(g AS VARCHAR) AS image_id, CAST(row_number() OVER (PARTITION BY g ORDER BY place, k) - 1 AS INTEGER) AS ord, code, name FROM e""",
)
def q41(spark, sf):
    return collage(spark, sf).markers().select("image_id", "ord", "code", "name")


@query(
    "q42_scan_segments",
    f"""WITH {_IMAGES}, e AS (SELECT *, unnest(range(segs)) AS k FROM sg)
    SELECT CAST(g AS VARCHAR) AS image_id, CAST(scan_idx AS INTEGER) AS scan_idx, CAST(k AS INTEGER) AS segment_idx, CAST(k * restart AS BIGINT) AS first_mcu, CAST(CASE WHEN restart = 0 THEN mx * my ELSE least(restart, mx * my - k * restart) END AS BIGINT) AS num_mcus,
      CAST(mx AS INTEGER) AS num_mcus_x FROM e""",
)
def q42(spark, sf):
    return collage(spark, sf).segments().select("image_id", "scan_idx", "segment_idx", "first_mcu", "num_mcus", "num_mcus_x")


@query("q56_segment_invariants", f"WITH {_IMAGES}, e AS (SELECT *, unnest(range(segs)) AS k FROM sg) SELECT CAST(g AS VARCHAR) AS image_id, CAST(scan_idx AS INTEGER) AS scan_idx, CAST(k AS INTEGER) AS segment_idx, true AS bytes_agree, true AS subsequences_agree FROM e")
def q56(spark, sf):
    """OP-32: the segments of byte tables, by prefix sums over bytes, are those that the parser counts in whole streams."""
    # streams and bytes are read several times below; neither is made again
    made = files.written(header.headers(collage(spark, sf).images, with_content=True).select("image_id", "scans", "content"), "streams")
    parsed = _dealt(made, "image_id").select("image_id", F.explode("scans").alias("s"), "content")
    data = parsed.select("image_id", F.col("s.scan_idx").alias("scan_idx"), F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), "content").select("image_id", "scan_idx", F.posexplode(F.expr("transform(sequence(begin + 1, end), k -> cast(conv(hex(substring(content, cast(k as int), 1)), 16, 10) as int))")).alias("pos", "b"))
    indexed = files.written(destuff.segment_index(destuff.byte_flags(data.withColumn("pos", F.col("pos").cast("bigint")))), "bytes")
    segs = destuff.segments(indexed)
    heads = destuff.subsequence_map(destuff.destuffed_bytes(destuff.destuff_offset(indexed), segs)).groupBy("image_id", "scan_idx", "segment_idx").agg(F.count("*").alias("heads"))
    whole = parsed.select("image_id", F.col("s.scan_idx").alias("scan_idx"), F.explode("s.segments").alias("g")).select("image_id", "scan_idx", "g.segment_idx", F.col("g.num_bytes").alias("counted"))
    both = segs.join(heads, ["image_id", "scan_idx", "segment_idx"], "left").join(whole, ["image_id", "scan_idx", "segment_idx"], "full_outer")
    agree = lambda x: F.coalesce(x, F.lit(False))
    return both.select("image_id", "scan_idx", "segment_idx", agree(F.col("num_bytes") == F.col("counted")).alias("bytes_agree"), agree(F.coalesce("heads", F.lit(0)) == expr.ceil_div(F.col("counted"), 128)).alias("subsequences_agree"))


@query(
    "q43_scan_geometry",
    f"""WITH {_IMAGES}, c AS (SELECT sg.*, unnest(CASE WHEN scans = 2 AND scan_idx = 0 OR components = 1 THEN [0] WHEN scans = 2 THEN [1, 2] ELSE [0, 1, 2] END) AS comp FROM sg),
    f AS (SELECT *, CASE WHEN units = 1 OR comp > 0 THEN 1 ELSE sx END AS ux, CASE WHEN units = 1 OR comp > 0 THEN 1 ELSE sy END AS uy FROM c)
    SELECT CAST(g AS VARCHAR) AS image_id, CAST(scan_idx AS INTEGER) AS scan_idx, CAST(comp AS INTEGER) AS component_idx, CAST(8 * ux AS INTEGER) AS mcu_x, CAST(8 * uy AS INTEGER) AS mcu_y, CAST(8 * ux * mx AS INTEGER) AS data_x, CAST(8 * uy * my AS INTEGER) AS data_y,
      CAST(comp AS INTEGER) AS table_id, CAST((SELECT sum((1 + (comp * 7 + i) % 31) * (i + 1)) FROM range(64) t(i)) AS BIGINT) AS q_check FROM f""",
)
def q43(spark, sf):
    """Components of scans, and the divisors that hold for them."""
    c = collage(spark, sf)
    check = F.aggregate(F.transform("q", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    used = c.scan_components().join(c.components().select("image_id", "component_idx", F.col("qtable_idx").alias("table_id")), ["image_id", "component_idx"])
    both = used.join(c.qtables(), ["image_id", "scan_idx", "table_id"])
    return both.select("image_id", "scan_idx", "component_idx", "mcu_x", "mcu_y", "data_x", "data_y", "table_id", check.alias("q_check"))


# ---------------------------------------------------------------- table functions, dealing, latency


@query(
    "q51_lateral_markers",
    f"""WITH {_IMAGES}, m(code, what, place) AS (VALUES (216, 0, 0), (219, 1, 1), (192, 0, 2), (196, 2, 3), (221, 3, 4), (218, 4, 5), (217, 0, 6)),
    e AS (SELECT g, code, CASE what WHEN 0 THEN 1 WHEN 1 THEN components WHEN 2 THEN 2 WHEN 3 THEN CASE WHEN restart > 0 THEN 1 ELSE 0 END ELSE scans END AS n FROM im, m)
    SELECT CAST(g AS VARCHAR) AS image_id, code, n::BIGINT AS n FROM e WHERE n > 0""",
)
def q51(spark, sf):
    """SQL over a binary column: how often each marker stands in each stream."""
    functions.register(spark)
    return spark.sql("SELECT image_id, m.code, count(*) AS n FROM {images}, LATERAL jpeg_markers(content) m GROUP BY image_id, m.code", images=collage(spark, sf).images)


@query("q52_dealing_by_cost", "SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS cost, 8 AS tasks, true AS even FROM documents")
def q52(spark, sf):
    """All documents dealt to eight tasks by their bytes: no task has over 1.2 times the mean (or the one largest row)."""
    d = _table(spark, sf, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("cost"))
    per = dealing.deal(d, "cost", 8, key="doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.max("cost").alias("top"))
    even = F.max("cost") <= F.greatest(F.sum("cost") / 8 * 1.2, F.max("top"))
    return per.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.count("*").cast("int").alias("tasks"), even.alias("even"))


@query(
    "q53_decode_latency",
    f"WITH {_IMAGES} SELECT CAST(g AS VARCHAR) AS image_id, 3 AS iterations, CAST(max(w * h) + max(CASE WHEN components = 3 THEN 2 * ((w + sx - 1) // sx) * ((h + sy - 1) // sy) ELSE 0 END) AS BIGINT) AS samples, true AS timed FROM im GROUP BY g",
)
def q53(spark, sf):
    """Real decodes, three times each after one that does not count; times themselves differ by run."""
    t = collage(spark, sf).latency(iterations=3, warm_up=1)
    return t.select("image_id", "iterations", "samples", ((F.col("max_ms") > 0) & (F.col("milliseconds") <= F.col("max_ms") + 1e-9) & (F.abs(F.col("total_ms") / 3 - F.col("milliseconds")) < 1e-6)).alias("timed"))


# ---------------------------------------------------------------- pixels to streams

_BASE = ", ".join(str((k, luma, chroma)) for k, (luma, chroma) in enumerate(zip(fixed.LUMA_TABLE, fixed.CHROMA_TABLE)))
_FORWARD = f"""s AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 256))) AS BIGINT) - 128 AS p FROM embeddings),
m(u, x, c) AS (VALUES {', '.join(str((u, x, v)) for u, row in enumerate(forward.MATRIX) for x, v in enumerate(row))}), base(i, luma, chroma) AS (VALUES {_BASE}),
t AS (SELECT vec_id, u, i % 8 AS x, sum(c * p) AS v FROM s JOIN m ON m.x = i // 8 GROUP BY vec_id, u, i % 8),
f AS (SELECT vec_id, t.u * 8 + m.u AS i, sum(v * c) AS f FROM t JOIN m ON m.x = t.x GROUP BY vec_id, t.u, m.u),
d AS (SELECT vec_id, f.i, f, greatest(1, least(255, (CASE WHEN vec_id % 2 = 0 THEN luma ELSE chroma END * 50 + 50) // 100))::BIGINT AS q FROM f JOIN base USING (i)),
co AS (SELECT vec_id, i, q, CAST(sign(f) * ((2 * abs(f) + q * {1 << 2 * forward.BITS}) // (q * {1 << 2 * forward.BITS + 1})) AS BIGINT) AS c FROM d)"""


def sample_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a block of 64 samples, with the divisors of quality 75: luma's, or of odd vectors chroma's."""
    px = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 256))).cast("bigint"))
    luma, chroma = (F.array(*[F.lit(v) for v in forward.scaled_table(t, 75)]) for t in (fixed.LUMA_TABLE, fixed.CHROMA_TABLE))
    return _table(spark, sf, "embeddings").select("vec_id", px.alias("px"), F.when(F.col("vec_id") % 2 == 0, luma).otherwise(chroma).alias("q"))


@query(
    "q54_raster_files",
    f"""{_RGB}, k(kind) AS (VALUES ('bmp'), ('tga'))
    SELECT kind, CAST(g AS VARCHAR) AS image_id, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, CAST(sum(r + gr + b) AS BIGINT) AS rgb_sum,
      CAST(sum(r * (1 + i % 997) + gr * (1 + (i + 1) % 997) + b * (1 + (i + 2) % 997)) AS BIGINT) AS rgb_check FROM i, k GROUP BY g, kind""",
)
def q54(spark, sf):
    """Bits to BMP and run-length TGA files, and the samples that are read back from them."""
    zero, c, out = F.lit(0).cast("bigint"), collage(spark, sf), None
    for kind in ("bmp", "tga"):
        back = raster.decode(c.encoded(kind), kind).select(F.lit(kind).alias("kind"), "image_id", "width", "height", "rgb")
        out = back if out is None else out.unionByName(back)
    sample = F.transform(F.sequence(F.lit(0), F.octet_length("rgb") - 1), lambda i: F.conv(F.hex(F.substr("rgb", i + 1, F.lit(1))), 16, 10).cast("bigint"))
    return out.withColumn("s", sample).select(
        "kind", "image_id", "width", "height", F.aggregate("s", zero, lambda a, v: a + v).alias("rgb_sum"), F.aggregate(F.transform("s", lambda v, i: v * (1 + i % 997)), zero, lambda a, v: a + v).alias("rgb_check")
    )


@query("q47_forward_dct", f"WITH {_FORWARD} SELECT vec_id, CAST(i AS INTEGER) AS i, c FROM co")
def q47(spark, sf):
    return forward.quantized_blocks(sample_blocks(spark, sf)).select("vec_id", F.posexplode("coef").alias("i", "c"))


@query(
    "q48_pixels_to_stream",
    f"WITH {_FORWARD}, x AS (SELECT vec_id, i // 8 AS r, i % 8 AS k, {_WRAP.format('c * q')} AS v FROM co), y AS {_pass('x', 'vec_id', 'r', 'k')}, z AS {_pass('y', 'vec_id', 'k', 'r')}, "
    f"px AS (SELECT vec_id, r, k, greatest(0, least(255, {_WRAP.format('v + 128')})) AS px FROM z WHERE vec_id % 2 = 0) SELECT CAST(vec_id AS VARCHAR) AS image_id, CAST(sum(px) AS BIGINT) AS px_sum, CAST(sum(px * (r * 8 + k + 1)) AS BIGINT) AS px_check FROM px GROUP BY vec_id",
)
def q48(spark, sf):
    """Grey pictures of 8x8 pixels, one of each even vector, to streams and back to pixels."""
    grey = _dealt(sample_blocks(spark, sf).where("vec_id % 2 = 0"), "vec_id").select(
        F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("num_components"),
        F.unhex(F.array_join(F.transform("px", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), "")).alias("rgb"),
    )
    zero = F.lit(0).cast("bigint")
    back = RasterCollection(jpeg.encode_rgb(grey, quality=75)).pixel_blocks()
    return back.select("image_id", F.aggregate("px", zero, lambda a, v: a + v).alias("px_sum"), F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), zero, lambda a, v: a + v).alias("px_check"))


# ---------------------------------------------------------------- streams that break the standard


def broken_streams() -> list[tuple[bytes | None, str]]:
    """One small 4:2:0 stream, and what is wrong in it, with the status that it must give."""
    sampling = [(2, 2), (1, 1), (1, 1)]
    zeros = [np.zeros((1 * y, 2 * x, 64), np.int64) for x, y in sampling]
    make = lambda **o: jpeg.encode(20, 13, sampling, zeros, [[1] * 64] * 3, **o)
    good = make()
    dqt, sof, dht, sos = (good.index(bytes([0xFF, m])) for m in (0xDB, 0xC0, 0xC4, 0xDA))

    def at(k: int, *values: int) -> bytes:
        return good[:k] + bytes(values) + good[k + len(values) :]

    interval = lambda n: bytes([0xFF, 0xDD, 0, 4, 0, n])
    ok, bad, no, cut = "SUCCESS", "INVALID_JPEG", "NOT_SUPPORTED", "INCOMPLETE_BITSTREAM"
    return [
        (good, ok), (None, "INVALID_ARGUMENT"), (b"", bad), (at(0, 0xFF, 0xD9), bad), (at(0, 0xFE), bad), (at(sof, 0xFF, 0xC1), ok), (at(sof, 0xFF, 0xC2), no), (at(sof, 0xFF, 0xC9), no),
        (at(sof + 4, 12), no), (at(sof + 5, 0, 0), bad), (at(sof + 7, 0, 0), bad), (at(sof + 9, 5), no), (at(sof + 9, 0), bad), (at(sof + 11, 0x51), bad), (at(sof + 11, 0x02), bad), (at(sof + 12, 4), bad),
        (good[:2] + good[sof : sof + 19] + good[2:], bad), (at(dht + 4, 0x20), bad), (at(dht + 4, 0x04), no), (at(dht + 5, 255), bad), (at(dqt + 4, 0x10), no), (at(dqt + 4, 0x05), bad),
        (make(extra=interval(2) * 2), ok), (make(extra=interval(2) + interval(3)), no), (make(extra=b"\xff\xe0\x00\x04ab\xff\xfe\x00\x03x"), ok), (make(extra=b"\xff\xe0\x00\x01"), bad),
        (at(sos + 4, 0), bad), (at(sos + 5, 9), bad), (at(sos + 7, 1), bad), (at(sos + 6, 0x11), bad), (at(sos + 6, 0x40), bad), (at(sos + 12, 20), no),
        (make(scans=[[0], [0], [1], [2]]), bad), (make(scans=[[0], [1]]), bad), (make(scans=[[0], [1], [2]]), ok), (good[:-2], bad), (good[:2] + good[sos:], bad), (b"\xff\xd8\xff\xd9", bad),
        (good[:2] + b"\xff\xff" + good[2:], ok), (b"\xff\xd8\xff\xe0\x00\x20ab", cut), (good[: sof + 12], cut), (good[: sos + 9], cut),
    ]


_STATUSES = [status for _, status in broken_streams()]


@query(
    "q44_status",
    f"""WITH s(k, status) AS (VALUES {', '.join(str((k, x)) for k, x in enumerate(_STATUSES))})
    SELECT CAST(p_partkey AS VARCHAR) AS image_id, status, CASE status WHEN 'SUCCESS' THEN 'success' WHEN 'INVALID_ARGUMENT' THEN 'invalid argument' WHEN 'INVALID_JPEG' THEN 'invalid jpeg'
      WHEN 'NOT_SUPPORTED' THEN 'jpeg is not supported' ELSE 'incomplete bitstream' END AS message, status = 'SUCCESS' AS decoded FROM part JOIN s ON p_partkey % {len(_STATUSES)} = k""",
)
def q44(spark, sf):
    """The status of good and broken streams, and whether they give pixels."""
    streams = F.broadcast(spark.createDataFrame([(k, data) for k, (data, _) in enumerate(broken_streams())], "k int, content binary"))
    parts = _dealt(_table(spark, sf, "part").select("p_partkey"), "p_partkey")
    each = parts.select(F.col("p_partkey").cast("string").alias("image_id"), (F.col("p_partkey") % len(_STATUSES)).cast("int").alias("k")).join(streams, "k")
    c = RasterCollection(each.select("image_id", F.length("content").cast("bigint").alias("length"), "content"))
    decoded = c.planes().where("component_idx = 0").select("image_id", F.lit(True).alias("decoded"))
    return c.frames().join(decoded, "image_id", "left").select("image_id", "status", "message", F.coalesce("decoded", F.lit(False)).alias("decoded"))


# ---------------------------------------------------------------- files


@query("q45_image_files", f"WITH {_IMAGES} SELECT g || '.jpg' AS file, true AS whole, 'SUCCESS' AS status, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height FROM im")
def q45(spark, sf):
    """Streams written as files and read again: names, lengths and headers."""
    folder = f"{files.scratch_folder(spark)}/lumiframe/images-{uuid.uuid4().hex}"
    made = collage(spark, sf).images.select(F.concat("image_id", F.lit(".jpg")).alias("file"), "length", "content")
    files.write_files(made, folder).write.format("noop").mode("overwrite").save()
    c = RasterCollection.read(spark, folder)
    name = lambda df: df.withColumn("file", F.substring_index("image_id", "/", -1))
    read = name(c.images).select("file", F.col("length").alias("read"))
    both = name(c.frames()).join(read, "file").join(made.select("file", "length"), "file")
    return both.select("file", (F.col("read") == F.col("length")).alias("whole"), "status", "width", "height")


@query(
    "q49_ranged_headers",
    f"""WITH {_IMAGES}, c AS (SELECT g, w, h, components, scans, mx * my AS mcus, sx, sy, unnest(range(components)) AS comp FROM sg WHERE scan_idx = 0)
    SELECT g || '.jpg' AS file, 'SUCCESS' AS status, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CAST(scans AS INTEGER) AS num_scans, CAST(comp AS INTEGER) AS component_idx,
      CAST(CASE WHEN comp = 0 THEN w ELSE (w + sx - 1) // sx END AS INTEGER) AS component_width, CAST((SELECT sum((1 + (comp * 7 + i) % 31) * (i + 1)) FROM range(64) t(i)) AS BIGINT) AS q_check, true AS in_part FROM c""",
)
def q49(spark, sf):
    """Streams written as files, and their headers by ranges: frames, components and divisors without the pixels."""
    folder = f"{files.scratch_folder(spark)}/lumiframe/images-{uuid.uuid4().hex}"
    files.write_files(collage(spark, sf).images.select(F.concat("image_id", F.lit(".jpg")).alias("file"), "content"), folder).write.format("noop").mode("overwrite").save()
    parsed = RasterCollection.read_ranged(spark, folder).headers.select(F.substring_index("image_id", "/", -1).alias("file"), "status", "width", "height", "scans", F.explode("components").alias("c"), (F.col("bytes_read") <= F.col("length")).alias("in_part"))
    table = F.filter(F.flatten("scans.qtables"), lambda q: q["table_id"] == F.col("c.qtable_idx"))[0]["q"]
    check = F.aggregate(F.transform(table, lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return parsed.select("file", "status", "width", "height", F.size("scans").alias("num_scans"), "c.component_idx", F.col("c.width").alias("component_width"), check.alias("q_check"), "in_part")


@query("q50_segments_by_ranges", f"WITH {_IMAGES}, e AS (SELECT *, unnest(range(segs)) AS k FROM sg) SELECT g || '.jpg' AS file, CAST(scan_idx AS INTEGER) AS scan_idx, CAST(k AS INTEGER) AS segment_idx, true AS same FROM e")
def q50(spark, sf):
    """Files cut into ranges of 64 bytes over tasks: the segments that the parser finds in whole streams."""
    folder = f"{files.scratch_folder(spark)}/lumiframe/images-{uuid.uuid4().hex}"
    made = collage(spark, sf)
    files.write_files(made.images.select(F.concat("image_id", F.lit(".jpg")).alias("file"), "content"), folder).write.format("noop").mode("overwrite").save()
    by_ranges = RasterCollection.read_ranged(spark, folder, size=64).scan_segments().withColumn("file", F.substring_index("image_id", "/", -1)).drop("image_id")
    whole = made.headers.select(F.concat("image_id", F.lit(".jpg")).alias("file"), F.explode("scans").alias("s")).select("file", "s.scan_idx", F.explode("s.segments").alias("g"))
    both = by_ranges.join(whole, (by_ranges.file == whole.file) & (by_ranges.scan_idx == whole.scan_idx) & (by_ranges.segment_idx == whole.g.segment_idx), "full_outer")
    same = (by_ranges.begin == whole.g.begin) & (by_ranges.end == whole.g.end) & (by_ranges.num_bytes == whole.g.num_bytes)
    return both.select(F.coalesce(whole.file, by_ranges.file).alias("file"), F.coalesce(whole.scan_idx, by_ranges.scan_idx).alias("scan_idx"), F.coalesce(whole.g.segment_idx, by_ranges.segment_idx).alias("segment_idx"), F.coalesce(same, F.lit(False)).alias("same"))
