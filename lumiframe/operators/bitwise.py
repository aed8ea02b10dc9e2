"""The entropy decoder as column expressions: the readable form beside the fast one in :mod:`.huffman`.

A segment's bytes are an array, a code is found as the range of codes of its length
that the next 16 bits begin with, and ``aggregate`` folds the state (bit position,
unit, index in the block, DC sums, coefficients so far) over one symbol a step.  No
Python runs; it is for checking the other form and for short segments, since every
step copies the coefficients that a segment has so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import NATURAL_ORDER


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``value`` as a variable, made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Of a table (counts, huffval): length, first code, number of codes and place of the first value, for each length that has codes.
_RANGES = """filter(transform(sequence(1, 16), n -> named_struct('n', n,
    'first', aggregate(sequence(1, 16), 0L, (a, k) -> a + if(k < n, t.counts[k - 1] * shiftleft(1L, n - k), 0L)),
    'size', cast(t.counts[n - 1] as bigint),
    'at', aggregate(slice(t.counts, 1, n), 0L, (a, c) -> a + c) - t.counts[n - 1])), r -> r.size > 0)"""


def _window(p: str) -> str:
    """The 16 bits from ``p`` on; zeros past the end."""
    byte = lambda k: f"coalesce(get(bytes, cast({p} div 8 + {k} as int)), 0L)"
    return f"(shiftright({byte(0)} * 65536L + {byte(1)} * 256L + {byte(2)}, cast(8 - {p} % 8 as int)) & 65535L)"


def _step() -> str:
    """The state after one more symbol."""
    state = lambda p, u, z, dc, out, done: f"named_struct('p', {p}, 'u', {u}, 'z', {z}, 'dc', {dc}, 'out', {out}, 'done', {done})"
    stop = state("s.p", "s.u", "s.z", "s.dc", "s.out", "true")
    natural = f"array({', '.join(f'{n}L' for n in NATURAL_ORDER)})"
    put = f"if(at < 64 and (v <> 0), concat(s.out, array(named_struct('i', s.u * 64 + {natural}[cast(at as int)], 'v', v))), s.out)"
    sums = "if(s.z = 0, transform(s.dc, (d, k) -> if(k = m.component_idx, v, d)), s.dc)"
    after = "if(s.z > 0 and cat = 0, if(run = 15, s.z + 16, 64L), at + 1)"
    moved = _let("z", after, state("q + cat", "if(z >= 64, s.u + 1, s.u)", "if(z >= 64, 0L, z)", sums, put, "false"))
    value = "if(cat = 0, 0L, " + _let("raw", f"shiftright({_window('q')}, cast(16 - cat as int))", "if(raw < shiftleft(1L, cast(cat - 1 as int)), raw + 1 - shiftleft(1L, cast(cat as int)), raw)") + ")"
    wrapped = _let("d", value, "((if(s.z = 0, s.dc[m.component_idx] + d, d) + 32768) & 65535L) - 32768")
    symbol = "t.huffval[cast(r.at + shiftright(w, 16 - r.n) - r.first as int)]"
    body = _let("run", "if(s.z = 0, 0L, cast(shiftright(sym, 4) as bigint))", _let("cat", "cast(sym & 15 as bigint)", _let("q", "s.p + r.n", _let("at", "s.z + run", _let("v", wrapped, moved)))))
    found = _let("r", "get(filter(t.ranges, x -> shiftright(w, 16 - x.n) between x.first and x.first + x.size - 1), 0)", f"if(r is null, {stop}, {_let('sym', symbol, body)})")
    table = _let("t", "if(s.z = 0, m.dc, m.ac)", _let("w", _window("s.p"), found))
    one = _let("m", "layout[cast(s.u % size(layout) as int)]", table)
    return f"if(s.done or s.u >= units or s.p div 8 > size(bytes) + 64, {stop}, {one})"


def units(segments: DataFrame) -> DataFrame:
    """OP-34, OP-36 to OP-40: (image_id, scan_idx, segment_idx, unit, coef) of runs of segments (:func:`.decode.parts`).

    Equal to :func:`.decode.units`, other columns left out.  ``unit`` counts in the scan.
    """
    tables = F.expr(f"transform(huff_tables, t -> named_struct('slot', t.slot, 'huffval', t.huffval, 'ranges', {_RANGES}))")
    known = segments.withColumn("tables", tables)
    of = lambda slot: f"get(filter(tables, t -> t.slot = {slot}), 0)"
    layout = F.expr(f"transform(mcu, m -> named_struct('component_idx', m.component_idx, 'dc', {of('2 * m.dc_idx')}, 'ac', {of('2 * m.ac_idx + 1')}))")
    each = known.select("image_id", "scan_idx", layout.alias("layout"), F.explode("segments").alias("g"))
    each = each.select("image_id", "scan_idx", "layout", "g.segment_idx", F.expr("g.num_mcus * size(layout)").alias("units"), F.expr("g.first_mcu * size(layout)").alias("first_unit"), F.hex("g.data").alias("hex"))
    each = each.withColumn("bytes", F.expr("if(hex = '', cast(array() as array<bigint>), transform(sequence(1, length(hex) div 2), k -> cast(conv(substring(hex, 2 * k - 1, 2), 16, 10) as bigint)))")).drop("hex")
    start = "named_struct('p', 0L, 'u', 0L, 'z', 0L, 'dc', array(0L, 0L, 0L, 0L), 'out', cast(array() as array<struct<i: bigint, v: bigint>>), 'done', false)"
    # a unit has 64 symbols at most
    folded = each.withColumn("out", F.expr(f"map_from_entries(aggregate(sequence(1, cast(64 * units as int)), {start}, (s, k) -> {_step()}).out)"))
    blocks = F.expr("transform(sequence(0L, units - 1), u -> named_struct('unit', first_unit + u, 'coef', transform(sequence(0, 63), i -> cast(coalesce(try_element_at(out, u * 64 + i), 0L) as smallint))))")
    return folded.select("image_id", "scan_idx", "segment_idx", F.explode(blocks).alias("b")).select("image_id", "scan_idx", "segment_idx", "b.unit", "b.coef")
