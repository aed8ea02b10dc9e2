"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: A-Z lower-cased, words are runs of bytes outside ASCII white
space, 3-word shingles with repeats (fewer words: the whole sequence; none:
fingerprint 0), XXH64 with seed 42; a bit is set if it is set in over half of
the hashes.

Search, over the *distinct* fingerprints only:

1. second moments of all fingerprints' bits group correlated bits into ``m``
   partitions;
2. candidate counts are estimated for each partition and threshold, and dynamic
   programming gives the partitions unequal thresholds that sum to
   ``radius - m + 1`` (-1: not probed), for each ``m``; the cheapest plan is used;
3. each fingerprint is indexed under its value in each partition and probes all
   values within the threshold; candidates are verified by their Hamming distance;
4. a value that over ``crowded`` fingerprints share is not expanded into pairs.
   At radius 2 its members meet, exactly, in the centres around them (two
   fingerprints within 2 bits have a common neighbour within 1 bit), so the cost is
   linear in the group.  At any other radius they are compared by blocks, and each
   pair of blocks returns only a spanning forest of its links.

The plan keeps values uncrowded as the table grows: beyond some 40 million
fingerprints it takes two partitions of 32 bits, one probed within one bit.

Then connected components.  Copies never meet: they share a fingerprint.

Defined cases: a null text is an empty one; repeated rows and ids are rows of
their own; an empty table gives an empty result; a null id never is a component
id unless all of the component are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, discard, fresh, materialize, with_row_key
from .components import connected_components, forest

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # byte -> its bits, high first


def fingerprint_text(text: str | None, words: int = 3) -> int:
    """The fingerprint, unsigned."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    if len(hashes) < 200:
        ones = np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` and ``out``, the fingerprint as a signed long."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint_text(t) for t in texts.to_pylist()], np.uint64).view(np.int64))]

        return run

    return append_columns(docs, text_col, [T.StructField(out, T.LongType())], make)


# ---------------------------------------------------------------- planning


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count, and the 64x64 counts of bits set together, over all rows of ``fps`` (column fp)."""

    def part(batches):
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            raw = b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float32)
            for k in range(0, len(x), 8192):
                both += x[k : k + 8192].T @ x[k : k + 8192]
            n += len(x)
        if n:
            i, j = np.divmod(np.arange(4096), 64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(both.ravel(), n))], names=["i", "j", "s"])

    got = fps.select("fp").mapInArrow(part, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # 4097 rows at most
    both, n = np.zeros((65, 65)), 0
    for r in got:
        both[r["i"], r["j"]] = r["s"]
    n = int(both[64, 64])
    return n, both[:64, :64]


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about 64/m bits, each gathering the bits most correlated with its own."""
    mean = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    rho = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(sd, sd))
    np.fill_diagonal(rho, 0)
    left, groups = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        seed = max(left, key=lambda b: (rho[b, sorted(left)].sum(), -b))
        own = [seed]
        left.remove(seed)
        while len(own) < size and left:
            best = max(left, key=lambda b: (rho[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def _within(mean: np.ndarray, bits: list[int], top: int) -> np.ndarray:
    """P(two fingerprints differ in at most t of ``bits``), t = 0 .. top."""
    dist = np.zeros(top + 2)
    dist[0] = 1.0
    for b in bits:
        q = 2 * mean[b] * (1 - mean[b])
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)[: top + 1]


def plan(n: int, both: np.ndarray, radius: int, candidates_per_probe: float = 1.0) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, cheapest by estimated candidates and probes."""
    mean = np.diag(both) / max(n, 1)
    best_cost, best = math.inf, []
    for m in range(2, radius + 2):
        groups = group_bits(n, both, m)
        total = radius - m + 1
        # state: the sum of thresholds so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            p = _within(mean, bits, radius)
            new: dict[int, tuple[float, list[int]]] = {}
            for at, (cost, chosen) in states.items():
                for t in range(-1, radius + 1):
                    probes = n * sum(math.comb(len(bits), k) for k in range(t + 1))
                    c = cost + (probes + candidates_per_probe * n * n / 2 * p[t] if t >= 0 else 0.0)
                    if at + t not in new or c < new[at + t][0]:
                        new[at + t] = (c, [*chosen, t])
            states = new
        if total in states and states[total][0] < best_cost:
            best_cost, best = states[total][0], list(zip(groups, states[total][1], strict=True))
    return best


# ---------------------------------------------------------------- search


def _mask(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def _flips(bits: list[int], t: int) -> list[int]:
    """Masks of 1 .. t bits among ``bits``, signed."""
    from itertools import combinations

    return [_mask(list(c)) for k in range(1, t + 1) for c in combinations(bits, k)]


def _crowd_links(met: DataFrame, radius: int, block: int) -> DataFrame:
    """Edges (a, b) among the fingerprints of crowded values (rows fp, part, v, index), in blocks."""
    sizes = met.groupBy("part", "v").agg(F.ceil(F.count("*") / block).cast("int").alias("ni"), F.ceil(F.sum(F.col("index").cast("int")) / block).cast("int").alias("nj"))
    both = met.join(sizes, ["part", "v"])
    at = lambda n: F.pmod(F.xxhash64("fp", F.lit("block")), F.col(n)).cast("int")
    probes = both.select("part", "v", "fp", F.lit(False).alias("index"), at("ni").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    known = both.where("index").select("part", "v", "fp", "index", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), at("nj").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        fp, index = t.column("fp").to_numpy(), t.column("index").to_numpy()
        node, place = np.unique(fp, return_inverse=True)
        left, right = np.unique(place[~index]), np.unique(place[index])
        a, b = [], []
        for lo in range(0, len(left), 512):
            own = left[lo : lo + 512]
            i, j = np.nonzero(np.bitwise_count(node[own].view(np.uint64)[:, None] ^ node[right].view(np.uint64)) <= radius)
            a.append(own[i])
            b.append(right[j])
        root = forest(np.concatenate(a), np.concatenate(b), len(node)) if a else np.arange(len(node))
        far = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[root[far]], "b": node[far]})

    return probes.unionByName(known).groupBy("part", "v", "i", "j").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, *, radius: int = 2, crowded: int = 64, block: int = 4096) -> DataFrame:
    """Edges (a, b) among the distinct fingerprints of ``fps`` (column fp).

    They connect exactly what all links (``radius`` or fewer bits differ) connect:
    where over ``crowded`` share a value, the centres that they have in common, or a
    spanning forest of their links, stand for the pairs.  At radius 2 all are links.
    """
    if radius < 1:
        raise ValueError("distinct fingerprints differ in one bit at least")
    n, both = bit_moments(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    parts = [(k, bits, t) for k, (bits, t) in enumerate(plan(n, both, radius)) if t >= 0]
    own = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v"), F.lit(True).alias("index")) for k, bits, _ in parts])
    def around(k: int, bits: list[int], t: int):
        """The values within ``t`` bits of a fingerprint's own in partition ``k``."""
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        return F.transform(F.array(*[F.lit(x).cast("long") for x in _flips(bits, t)]), lambda x: F.struct(F.lit(k).alias("part"), value.bitwiseXOR(x).alias("v"), F.lit(False).alias("index")))

    near = [around(k, bits, t) for k, bits, t in parts if t > 0]
    keys = fps.select("fp", F.explode(F.concat(own, *near) if near else own).alias("k")).select("fp", "k.*")
    count = keys.groupBy("part", "v").agg(F.sum(F.col("index").cast("long")).alias("n"), F.count("*").alias("all")).where("n >= 1 and all >= 2")
    met = materialize(keys.join(count, ["part", "v"]).select("fp", "part", "v", "index", "n"), "met")
    few = met.where(F.col("n") <= crowded)
    a = few.select("part", "v", F.col("fp").alias("a"), F.col("index").alias("ai"))
    b = few.where("index").select("part", "v", F.col("fp").alias("b"))
    pairs = a.join(b, ["part", "v"]).where("a <> b and (a < b or not ai)").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = met.where(F.col("n") > crowded)
    if radius != 2:
        return pairs.unionByName(_crowd_links(many.select("fp", "part", "v", "index"), radius, block)).distinct()
    many = many.select("fp").distinct()
    centre = many.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.array(*[F.lit(x).cast("long") for x in _flips(list(range(64)), 1)]), lambda x: F.col("fp").bitwiseXOR(x)))).alias("c"))
    least = centre.groupBy("c").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = centre.join(least, "c").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` for each row: the smallest id reachable through links."""
    rows = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), text_col="text").select("id", "fp"), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = connected_components(links(fps.select("fp"), radius=radius)).withColumnRenamed("node", "fp")
    classed = fps.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classed.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


# ---------------------------------------------------------------- copies of a stated similarity

_SEEDS = np.random.default_rng(11).integers(1, 2**63, (12, 2), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    LIMIT = 250_000

    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w, 42)
        return h


def shingle_hashes(text: str | None, hashes: _WordHashes, words: int) -> np.ndarray:
    """A 64-bit hash of each shingle, in order (fewer words: of the whole sequence)."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(hashes) > hashes.LIMIT:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def sketch(u: np.ndarray) -> tuple[int, np.ndarray]:
    """Of distinct shingles: SimHash of all, and of twelve min-wise samples of three of them.

    Two texts of Jaccard similarity 0.8 take the same sample with probability 0.51
    each, and then agree in its fingerprint.
    """
    ones = np.unpackbits(u.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    whole = int.from_bytes(np.packbits(ones * 2 > len(u)).tobytes(), "big")
    samples = np.zeros(len(_SEEDS), np.uint64)
    for k, (a, b) in enumerate(_SEEDS):
        x = (u ^ b) * a
        x ^= x >> np.uint64(31)
        own = u[np.argpartition(x, 2)[:3]] if len(u) > 3 else u
        p, q, r = (own[min(i, len(own) - 1)] for i in range(3))
        samples[k] = (p & q) | (q & r) | (p & r)  # the majority of three, bit by bit
    return whole, samples


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, d1, d2, n, fp, samples): digest of the text, number of distinct shingles, fingerprints."""
    fields = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("samples", T.ArrayType(T.LongType()))]

    def make():
        hashes = _WordHashes()

        def run(texts: pa.Array) -> list[pa.Array]:
            n, d, f, s = [], [], [], []
            for t in texts.to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                d.append(xxhash.xxh3_128_digest(raw))
                h = shingle_hashes(t, hashes, words)
                h = np.unique(h)
                n.append(len(h))
                whole, samples = sketch(h) if len(h) else (0, None)
                f.append(whole)
                s.append(None if samples is None else samples.view(np.int64))
            d = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            return [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(n, pa.int32()), pa.array(np.array(f, np.uint64).view(np.int64)), pa.array(s, pa.list_(pa.int64()))]

        return run

    return append_columns(docs, "text", fields, make).select("id", *[f.name for f in fields])


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes of each text, packed."""

    def make():
        hashes = _WordHashes()
        return lambda texts: [pa.array([np.unique(shingle_hashes(t, hashes, words)).tobytes() for t in texts.to_pylist()], pa.binary())]

    return append_columns(texts, "text", [T.StructField("set", T.BinaryType())], make).select("id", "set")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) and ``ok``: whether the exact Jaccard similarity of their shingles reaches ``similarity``."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return both.mapInArrow(run, T.StructType([both.schema["a"], both.schema["b"], T.StructField("ok", T.BooleanType())]))


def _prefix_pairs(sets: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``left`` and ``right`` (places in ``sets``) that can be similar and are of two groups, in parts.

    Prefix filter: of the shingles by rising frequency, a text similar to another
    has one in common with it among its first ``n - ceil(similarity * n) + 1``.
    Shared template text is frequent, so it is in no prefix.
    """
    size = np.array([len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((code, count[code], text))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    short = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    code, text = code[order], text[order]
    own = (place < short[text]) & (count[code] > 1)
    code, text = code[own], text[own]
    side = np.zeros((2, len(sets)), bool)
    side[0, left], side[1, right] = True, True
    by = np.argsort(code, kind="stable")
    code, text = code[by], text[by]
    heads = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1) if len(code) else np.empty(0, np.int64)
    seen = np.zeros((len(sets), len(sets)), bool)
    for lo, hi in zip(heads, np.append(heads[1:], len(code))):
        if hi - lo < 2:
            continue
        x = text[lo:hi]
        one, b = x[side[0, x]], x[side[1, x]]
        for at in range(0, len(one), 256):
            a = one[at : at + 256]
            low, high = np.minimum.outer(size[a], size[b]), np.maximum.outer(size[a], size[b])
            i, j = np.nonzero(~seen[np.ix_(a, b)] & (group[a][:, None] != group[b]) & (low >= similarity * high - 1e-9))
            i, j = a[i], b[j]
            seen[i, j] = seen[j, i] = True
            if len(i):
                yield i, j


def _rest_of_buckets(buckets: DataFrame, sets: DataFrame, similarity: float, *, block: int, block_bytes: int) -> DataFrame:
    """Edges (a, b) that connect all similar texts of one sample that were in different groups.

    ``buckets`` (t, s, id, root, samples): all texts of the samples in question.  A
    bucket over ``block`` texts, or ``block_bytes`` of sets, is cut into blocks, and
    each pair of blocks is a task's group; every pair of texts with different roots
    is verified there unless the prefix filter rules it out, the texts met in an
    earlier sample, or edges of the group connect them by then.  Only edges that
    join two groups are returned, fewer than a group has rows.
    """
    bucket = ["t", "s"]
    with_size = buckets.join(sets.select("id", F.octet_length("set").alias("bytes")), "id")
    sizes = with_size.groupBy(*bucket).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("nb"))
    blocked = buckets.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("nb")).cast("int"))
    dealt = blocked.select("id", "root", "samples", *bucket, "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("id", "root", "samples", *bucket, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    moved = dealt.join(sets, "id").select("id", "root", "samples", *bucket, "own", "i", "j", "set")
    key = [*bucket, "i", "j"]

    def joined(g: pa.Table) -> tuple[list, list]:
        ids, at = g.column("id").to_pylist(), {}
        group = np.array([at.setdefault(r, len(at)) for r in g.column("root").to_pylist()])
        if len(at) < 2:
            return [], []
        t, i, j = (g.column(c)[0].as_py() for c in ("t", "i", "j"))
        own = g.column("own").to_numpy()
        samples = g.column("samples").combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("set")]
        up = np.arange(len(at))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        a, b = [], []
        for x, y in _prefix_pairs(shingles, group, np.flatnonzero(own == i), np.flatnonzero(own == j), similarity):
            if t:  # met before, in an earlier sample
                apart = ~(samples[x, :t] == samples[y, :t]).any(1)
                x, y = x[apart], y[apart]
            for p, q in zip(x.tolist(), y.tolist()):
                m, n = top(group[p]), top(group[q])
                if m == n:
                    continue
                u, v = shingles[p], shingles[q]
                common = len(np.intersect1d(u, v, assume_unique=True))
                if common >= similarity * (len(u) + len(v) - common):
                    up[max(m, n)] = min(m, n)
                    a.append(min(ids[p], ids[q]))
                    b.append(max(ids[p], ids[q]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []  # the last group may go on in the next batch; it has two blocks' rows at most
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if batch is not None else None
            if now is not None:
                codes = np.stack([pc.rank(now.column(c).combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) for c in key])
                cuts = (np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist()
                parts = [now.slice(lo, hi - lo) for lo, hi in zip([0, *cuts], [*cuts, now.num_rows])]
                if rest and all(rest[0].column(c)[0] == parts[0].column(c)[0] for c in key):
                    rest.append(parts.pop(0))
                    if not parts:
                        continue
                whole, rest = [rest, *[[x] for x in parts[:-1]]] if rest else [[x] for x in parts[:-1]], [parts[-1]]
            else:
                whole, rest = [rest], []
            got = [joined(pa.concat_tables(x)) for x in whole if sum(y.num_rows for y in x) > 1]
            if any(x[0] for x in got):
                yield pa.RecordBatch.from_arrays([pa.array(itertools.chain.from_iterable(x[k] for x in got), kind) for k in (0, 1)], names=["a", "b"])

    kind = pa.string() if isinstance(sets.schema["id"].dataType, T.StringType) else pa.int32() if isinstance(sets.schema["id"].dataType, T.IntegerType) else pa.int64()
    together = moved.repartition(*key).sortWithinPartitions(*key)
    return together.mapInArrow(run, T.StructType([T.StructField("a", sets.schema["id"].dataType), T.StructField("b", sets.schema["id"].dataType)]))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, rounds: int = 4, block: int = 2048, block_bytes: int = 8_000_000) -> DataFrame:
    """``(id, component_id)``: groups of texts linked by shingle similarity, with equal texts.

    At this similarity whole-text fingerprints differ in up to 18 bits, beyond any
    radius that partitions of 64 bits can search.  Candidates therefore share the
    fingerprint of a min-wise sample (equality), or are within two bits as whole
    texts (the search of :func:`links`); all are verified exactly.  Texts of one
    sample are compared with its heart, the text that shares most samples.  Those
    not connected to it go on: in further rounds they are compared in turn with
    another of the sample's texts (by hash, a different one in each sample) and with
    the heart of those that are left.  So a group of thousands of copies costs about
    as many comparisons as it has members.  What is left then is compared exactly, by
    blocks: texts of one sample that are in different groups all meet
    (:func:`_rest_of_buckets`), so every similar pair that shares a sample is linked.
    Ids must be there and name one row each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = materialize(_sketches(rows, words), "sketches", batch_rows=2000)
    classes = known.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("samples").alias("samples"))
    classes = materialize(classes, "texts")
    facts = classes.where("n > 0").select("id", "n", "fp")
    whole = facts.groupBy("fp").agg(F.min("id").alias("low"))
    near = links(whole.select("fp"))
    pairs = facts.join(whole, "fp").select(F.col("low").alias("a"), F.col("id").alias("b"))
    pairs = pairs.unionByName(near.join(whole.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(whole.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    keys = classes.where("n > 0").select("id", F.posexplode("samples").alias("t", "s"))
    shared = keys.join(keys.groupBy("t", "s").agg(F.count("*").alias("m")).where("m > 1"), ["t", "s"])
    # a text that shares most samples is the likeliest centre of its group
    weight = shared.groupBy("id").agg(F.sum("m").alias("w"))
    shared = materialize(shared.join(weight, "id").select("id", "t", "s", "w"), "shared")
    pairs = materialize(pairs.where("a <> b"), "pairs")
    # only texts that share something are read again, once, as the sets that all rounds compare
    asked = shared.select("id").unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    asked = materialize(asked, "asked")
    sets = materialize(_shingle_sets(rows.join(asked, "id", "left_semi"), words), "sets", batch_rows=2000)
    heart = materialize(shared.groupBy("t", "s").agg(F.max(F.struct("w", "id"))["id"].alias("heart")), "hearts")
    done = [pairs, asked, sets, shared, heart]  # tables that nothing reads once the groups are known
    left, found, roots = shared.join(heart, ["t", "s"]).where("id <> heart").select("t", "s", "id", "w", "heart"), None, None
    for k in range(rounds):
        if k == 0:
            met = left.select("id", F.col("heart").alias("c"))
        elif k % 2:
            other = shared.groupBy("t", "s").agg(F.min_by("id", F.xxhash64("id", "t", F.lit(k))).alias("c"))
            met = left.join(other, ["t", "s"]).select("id", "c")
        else:
            own = left.groupBy("t", "s").agg(F.max(F.struct("w", "id"))["id"].alias("c"))
            met = left.join(own, ["t", "s"]).select("id", "c")
        new = met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
        new = (new.unionByName(pairs) if k == 0 else new).where("a <> b").distinct()
        sized = new.join(facts.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(facts.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        # sets of that similarity are of sizes within it: nothing similar is passed over
        likely = sized.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9).select("a", "b")
        checked = materialize(_similar(likely, sets, similarity), "checked", batch_rows=300)
        good = checked.where("ok").select("a", "b")
        found = good if found is None else found.unionByName(good)
        roots, old = materialize(connected_components(found), "roots"), roots
        discard(old)
        # those not connected to the heart of a sample that they share go on
        at = roots.select(F.col("node").alias("id"), "root")
        rest = left.join(at, "id", "left").join(at.select(F.col("id").alias("heart"), F.col("root").alias("hr")), "heart", "left")
        left = materialize(rest.where(F.coalesce("root", "id") != F.coalesce("hr", "heart")).select("t", "s", "id", "w", "heart"), "left")
        done += [checked, left]
        if left.isEmpty():
            break
    else:
        # the exact rest: all texts of the samples that still hold more than one group
        members = shared.join(left.select("t", "s").distinct(), ["t", "s"], "left_semi").select("t", "s", "id")
        members = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(classes.select("id", "samples"), "id")
        buckets = materialize(members.select("t", "s", "id", F.coalesce("root", "id").alias("root"), "samples"), "buckets")
        more = materialize(_rest_of_buckets(buckets, sets, similarity, block=block, block_bytes=block_bytes), "rest", batch_rows=300)
        done += [buckets, more]
        if not more.isEmpty():
            roots = materialize(connected_components(found.unionByName(more)), "roots")
    discard(*done)
    least = classes.join(roots, classes["id"] == roots["node"], "left").select("d1", "d2", F.coalesce("root", "id").alias("component_id"))
    return known.select("id", "d1", "d2").join(least, ["d1", "d2"]).select("id", "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id.

    Rows without an id cannot be told apart by it; they stay.  Of rows that repeat
    an id one stays (the first by text).
    """
    named = docs.where(F.col(id_col).isNotNull())
    if not named.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        tag = fresh(docs, "_row")
        named = materialize(named.withColumn(tag, F.monotonically_increasing_id()), "rows")
        firsts = named.groupBy(id_col).agg(F.min_by(tag, F.struct(F.col(text_col), F.col(tag))).alias(tag)).select(tag)
        named = materialize(named.join(firsts, tag, "left_semi").drop(tag), "rows")
    stay = similar_groups(named, id_col=id_col, text_col=text_col, words=words, similarity=similarity).where("id = component_id").select(F.col("id").alias(id_col))
    return named.join(stay, id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def keep_one_row_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, whatever its id.

    Rows are told apart by a key of their own; ids only say which row stays: the
    one of the smallest id, a null id last; of equal ids the first by a hash of the text.
    """
    rows, key = with_row_key(docs, "rows")
    groups = similar_groups(rows, id_col=key, text_col=text_col, words=words, similarity=similarity).select(F.col("id").alias(key), "component_id")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(key))
    stay = rows.select(key, order.alias("at")).join(groups, key).groupBy("component_id").agg(F.min_by(key, "at").alias(key)).select(key)
    return rows.join(stay, key, "left_semi").select(*docs.columns)
