"""Huffman tables as rows, and the entropy decoder.

Decoding a restart segment is serial in its bits; segments are independent.  So
a segment is a row, rows are the unit of parallelism, and the decoder runs in
Arrow batches over them, with a 16-bit lookup table per Huffman table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import NATURAL_ORDER


def canonical_codes(tables: DataFrame) -> DataFrame:
    """OP-10: rows (len, code, val) of (counts, huffval), other columns kept.

    The first code of length n is the sum of ``counts[k] * 2**(n - k)`` over shorter
    lengths k: a closed form, so no state runs along the codes.
    """
    keys = [c for c in tables.columns if c not in ("counts", "huffval")]
    codes = F.expr(
        """flatten(transform(sequence(1, 16), n -> transform(
             filter(sequence(0, 255), i -> i < counts[n - 1]),
             i -> named_struct('len', n,
                'code', cast(aggregate(sequence(1, 16), 0L, (a, k) -> a + if(k < n, counts[k - 1] * shiftleft(1L, n - k), 0L)) + i as int),
                'val', huffval[cast(aggregate(slice(counts, 1, n), 0L, (a, c) -> a + c) - counts[n - 1] + i as int)]))))"""
    )
    return tables.select(*keys, F.explode(codes).alias("c")).select(*keys, "c.len", "c.code", "c.val")


@lru_cache(maxsize=256)
def lookup_arrays(counts: tuple[int, ...], values: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Code length (0: no such code) and value for each 16-bit window."""
    size, value = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    code = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            lo = code << (16 - n)
            if lo >= 65536:
                return size, value
            size[lo : lo + (1 << (16 - n))] = n
            value[lo : lo + (1 << (16 - n))] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return size, value


@lru_cache(maxsize=32)
def lookup_table(counts: tuple[int, ...], values: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """The same as lists, which a loop over symbols reads faster."""
    size, value = lookup_arrays(counts, values)
    return size.tolist(), value.tolist()


def decode_segment(data: bytes, units: int, layout: list[tuple[int, tuple, tuple]], *, predict: bool = True) -> np.ndarray:
    """OP-36 to OP-40, OP-46: ``units`` blocks of 64 coefficients in raster order.

    ``data`` is destuffed; bits past its end read as 0.  ``layout`` has (component,
    DC lookup, AC lookup) of each unit of an MCU.  With ``predict`` the DC values
    are sums from the segment's start (OP-49), kept to 16 bits.  After a bit
    pattern that is no code, or 64 bytes past the end, the rest stays zero.
    """
    out = np.zeros((units, 64), np.int16)
    bits, have, at, end = 0, 0, 0, len(data)
    dc_sum: dict[int, int] = {}
    place = NATURAL_ORDER

    for u in range(units):
        comp, (dc_len, dc_val), (ac_len, ac_val) = layout[u % len(layout)]
        row: dict[int, int] = {}
        z = 0
        while z < 64:
            if have < 48:
                chunk = data[at : at + 8]
                at += 8
                if len(chunk) < 8:
                    chunk = chunk + b"\x00" * (8 - len(chunk))
                bits = (bits << 64) | int.from_bytes(chunk, "big")
                have += 64
            window = (bits >> (have - 16)) & 0xFFFF
            n = ac_len[window] if z else dc_len[window]
            if not n or (8 * at - have) >> 3 > end + 64:
                for i, v in row.items():
                    out[u, i] = v
                return out
            s = ac_val[window] if z else dc_val[window]
            have -= n
            if z:
                run, cat = s >> 4, s & 15
                if not cat:
                    if run != 15:
                        break
                    z += 16
                    continue
                z += run
            else:
                cat = s & 15
            v = 0
            if cat:
                have -= cat
                v = (bits >> have) & ((1 << cat) - 1)
                if v < 1 << (cat - 1):
                    v += 1 - (1 << cat)
            bits &= (1 << have) - 1
            if z == 0 and predict:
                v = dc_sum[comp] = ((dc_sum.get(comp, 0) + v + 32768) & 65535) - 32768
            if z < 64 and v:
                row[place[z]] = ((v + 32768) & 65535) - 32768
            z += 1
        if row:
            out[u, list(row)] = np.array(list(row.values())).astype(np.int16)
    return out


_NATURAL = np.array(NATURAL_ORDER)
#: Fewer segments than these are faster one by one.
SIDE_BY_SIDE = 64


Lane = tuple[bytes, int, list[tuple[int, tuple, tuple]]]
_HALF = np.array([0, *[1 << (n - 1) for n in range(1, 16)]], np.int64)
_FULL = np.array([(1 << n) - 1 for n in range(16)], np.int64)
_PAD = 96  # zeros after each segment: a lane stops 64 bytes past its end


@lru_cache(maxsize=256)
def _symbols(counts: tuple[int, ...], values: tuple[int, ...], ac: bool) -> np.ndarray:
    """For each 16-bit window, packed: code length (5 bits), magnitude bits (4), zeros before (4), and how far the symbol goes on in its block."""
    size, value = (x.astype(np.int32) for x in lookup_arrays(counts, values))
    bits, run = value & 15, value >> 4 if ac else np.zeros_like(value)
    on = np.where(bits > 0, run + 1, np.where(run == 15, 16, 64)) if ac else np.ones_like(value)
    return size | bits << 5 | run << 9 | on << 13


def decode_lanes(lanes: list[Lane], *, predict: bool = True) -> list[np.ndarray]:
    """Many segments at once: :func:`decode_segment` of each; see :func:`decode_all`."""
    ends = np.cumsum([n for _, n, _ in lanes])
    return np.split(decode_all(lanes, predict=predict), ends[:-1]) if lanes else []


def decode_all(lanes: list[Lane], *, predict: bool = True) -> np.ndarray:
    """The blocks of many segments, one after another; one symbol of every segment a step.

    ``lanes``: data, units, and (component, DC table, AC table) of each unit of an
    MCU, a table being its (counts, values).  The work of a step is spread over all
    segments of a batch, so collections of many images or restart intervals decode
    several times faster than one after another; a few lanes that are much longer
    than the others are finished one by one.
    """
    if len(lanes) < SIDE_BY_SIDE:
        return np.concatenate([_alone(*lane, predict) for lane in lanes]) if lanes else np.zeros((0, 64), np.int16)
    keys = sorted({(t, k) for _, _, layout in lanes for _, *ts in layout for k, t in enumerate(ts)})
    if len(keys) > 64:  # each is 256 KB
        half = len(lanes) // 2
        return np.concatenate([decode_all(lanes[:half], predict=predict), decode_all(lanes[half:], predict=predict)])
    number = {t: k << 16 for k, t in enumerate(keys)}
    symbols = np.concatenate([_symbols(*t, bool(k)) for t, k in keys])
    widest = max(len(layout) for _, _, layout in lanes)
    tables = np.zeros((2, len(lanes), widest), np.int64)
    for k, (_, _, layout) in enumerate(lanes):
        for c, (_, *ts) in enumerate(layout):
            tables[:, k, c] = [number[t, kind] for kind, t in enumerate(ts)]
    ac_tables, tables = len(lanes) * widest, tables.ravel()
    length = np.array([len(d) for d, _, _ in lanes])
    base = np.cumsum(length + _PAD) - (length + _PAD)
    raw = np.zeros(int(base[-1] + length[-1]) + _PAD + 8, np.uint64)
    for at, (d, _, _) in zip(base, lanes):
        raw[at : at + len(d)] = np.frombuffer(d, np.uint8)
    word = np.zeros(len(raw) - 8, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        word |= raw[k : len(raw) - 8 + k] << np.uint64(56 - 8 * k)
    total = np.array([n for _, n, _ in lanes])
    first = np.cumsum(total) - total
    out = np.zeros((int(total.sum()), 64), np.int16)
    flat = out.reshape(-1)
    reached = np.zeros(len(lanes), np.int64)

    # the lanes still at work, and their state: bit position, block, unit in the MCU, place in the block
    lane = np.flatnonzero(total > 0)
    pos, block, c, z = 8 * base[lane], first[lane].copy(), np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    limit, last, own, per = (base + length + 64)[lane], (first + total)[lane], lane * widest, np.array([len(layout) for _, _, layout in lanes])[lane]
    one, top = np.uint64(1), np.uint64(48)
    slow: list[int] = []
    while len(lane):
        byte, ac = pos >> 3, z > 0
        w = word[byte] << (pos & 7).view(np.uint64)
        e = symbols[tables[own + c + ac * ac_tables] + (w >> top).view(np.int64)].astype(np.int64)
        n = e & 31
        ok = (n > 0) & (byte <= limit)
        if not ok.all():
            gone = np.flatnonzero(~ok)
            # a segment that breaks off within a unit has reached it
            reached[lane[gone]] = block[gone] - first[lane[gone]] + ac[gone]
            lane, pos, block, c, z, limit, last, own, per, w, e, n = (x[ok] for x in (lane, pos, block, c, z, limit, last, own, per, w, e, n))
        bits = (e >> 5) & 15
        v = (((w << n.view(np.uint64)) >> one) >> (63 - bits).view(np.uint64)).view(np.int64)
        v -= _FULL[bits] * (v < _HALF[bits])
        at = z + ((e >> 9) & 15)
        if at.size and at.max() > 63:  # zeros that lead out of the block
            inside = np.flatnonzero(at < 64)
            flat[block[inside] * 64 + _NATURAL[at[inside]]] = v[inside].astype(np.int16)
        else:  # symbols without magnitude write a zero where one is
            flat[block * 64 + _NATURAL[at]] = v.astype(np.int16)
        pos += n
        pos += bits
        z += e >> 13
        over = z > 63
        z[over] = 0
        block += over
        c += over
        c[c == per] = 0
        done = block == last
        if done.any():
            reached[lane[done]] = total[lane[done]]
            go = ~done
            lane, pos, block, c, z, limit, last, own, per = (x[go] for x in (lane, pos, block, c, z, limit, last, own, per))
            if len(lane) < SIDE_BY_SIDE // 4 and len(lane) and ((block - first[lane]) / total[lane]).mean() < 0.5:
                slow = lane.tolist()
                break
    if predict:
        for k, (_, _, layout) in enumerate(lanes):
            mine = out[first[k] : first[k] + reached[k], 0]
            comps = np.array([x for x, _, _ in layout])[np.arange(len(mine)) % len(layout)]
            for x in set(comps.tolist()):
                sums = np.cumsum(mine[comps == x].astype(np.int64))
                mine[comps == x] = ((sums + 32768) & 65535) - 32768
    for k in slow:
        out[first[k] : first[k] + total[k]] = _alone(*lanes[k], predict)
    return out


def _alone(data: bytes, units: int, layout: list[tuple[int, tuple, tuple]], predict: bool) -> np.ndarray:
    return decode_segment(data, units, [(c, lookup_table(*dc), lookup_table(*ac)) for c, dc, ac in layout], predict=predict)
