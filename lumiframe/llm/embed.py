"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine, components.

1. Equal vectors of one label are one row with a multiplicity; copies never meet.
2. Each distinct vector gets a signature of ``bits`` signs in each of ``tables``
   tables (fixed seed).  Rows share a bucket if label, table and signature agree.
   Buckets of one row are dropped before any vector is moved.
3. Vectors of a bucket are compared by exact double-precision cosine.  A bucket
   over ``block`` rows is cut into blocks, and each pair of blocks is a task's group
   of its own, so no bucket has to fit in one task and no pair is left out.  A
   row moves once for each block of its bucket.
4. A pair that shares several buckets counts in the first table it shares only;
   tasks return each vector's number of links, and as edges only a spanning
   forest of what they linked, never all pairs.
5. Connected components over the edges.

Defined cases: vectors that are null, empty, all zero or hold a null or
non-finite component, and rows without a label, link with nothing (0 links, own
component, kept); vectors of different length never meet; rows that repeat a
vec_id are vectors of their own; an empty table gives an empty result.

Recall: a pair at cosine 0.98 agrees in a sign with probability 0.936; the
number of tables is such that it shares no bucket with probability 0.003.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .components import connected_components, forest


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signatures(vectors: DataFrame, *, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """``vectors`` (rep, label, v array<double>, mult) and ``sig``: a long for each table."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("sig", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            v = b.column("v")
            flat, size = v.flatten().to_numpy(), np.diff(v.offsets.to_numpy())
            first = np.cumsum(size) - size
            sig = np.zeros((len(v), tables), np.int64)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                x = flat[first[own][:, None] + np.arange(dim)]
                sig[own] = ((x @ _planes(int(dim), bits, tables, seed)) >= 0).reshape(len(own), tables, bits) @ power
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))], names=[f.name for f in schema.fields])

    return vectors.mapInArrow(run, schema)


def table_shape(n: int, threshold: float, miss: float = 0.003) -> tuple[int, int]:
    """Bits and tables for ``n`` vectors: about one chance row a bucket, a pair at the threshold missed with probability ``miss``."""
    bits = min(40, max(12, int(np.ceil(np.log2(max(n, 2))))))
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(miss) / np.log(1 - agree)))


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    bits: int | None = None,
    tables: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row.

    ``bits`` and ``tables`` follow from the number of vectors unless given.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("fit", F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))
    rows = rows.withColumn("fit", F.coalesce("fit", F.lit(False)))
    fit = rows.where("fit")
    classes = materialize(fit.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("mult")).select(F.monotonically_increasing_id().alias("rep"), "label", "v", "least", "mult"), "vectors")
    if bits is None or tables is None:
        bits, tables = table_shape(classes.count(), threshold)
    signed = materialize(signatures(classes.select("rep", "label", "v", "mult"), bits=bits, tables=tables), "signatures")
    keys = signed.select("rep", "label", F.size("v").alias("dim"), F.posexplode("sig").alias("t", "s"))
    sizes = keys.groupBy("label", "dim", "t", "s").agg(F.count("*").alias("n")).where("n > 1")
    # a row goes to every pair of blocks that its block is in
    blocked = keys.join(sizes, ["label", "dim", "t", "s"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = blocked.select("rep", "label", "dim", "t", "s", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("rep", "label", "dim", "t", "s", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    moved = dealt.join(signed.select("rep", "v", "mult", "sig"), "rep")

    def links(g: pa.Table) -> tuple[np.ndarray, ...]:
        """Of one pair of blocks: rows (a, b, n); a = b with the number of links, or a link of the forest with n = 0."""
        t, i, j = (g.column(c)[0].as_py() for c in ("t", "i", "j"))
        lists = lambda c: g.column(c).combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
        x, sig = lists("v").copy(), lists("sig")
        rep, mult, own = (g.column(c).to_numpy() for c in ("rep", "mult", "own"))
        norm = np.sqrt((x * x).sum(1))
        big = ~np.isfinite(norm) | (norm < 1e-100)
        if big.any():  # squares that overflow or vanish: scale these vectors first
            x[big] /= np.abs(x[big]).max(1, keepdims=True)
            norm[big] = np.sqrt((x[big] * x[big]).sum(1))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n, edges = np.zeros(len(x), np.int64), []
        for lo in range(0, len(left), 512):
            l = left[lo : lo + 512]
            ok = (x[l] @ x[right].T) / np.outer(norm[l], norm[right]) >= threshold
            for k in range(t):  # met before, in an earlier table
                ok &= sig[l, k][:, None] != sig[right, k][None, :]
            if i == j:
                ok &= rep[l][:, None] != rep[right][None, :]
            n[l] += ok @ mult[right]
            if i != j:
                n[right] += mult[l] @ ok
            a, b = np.nonzero(ok)
            if len(a):  # each node to the first of its component here: as many edges as nodes
                node = np.concatenate([l, right])
                root = node[forest(a, len(l) + b, len(node))]
                met = np.unique(np.concatenate([a, len(l) + b]))
                edges.append((rep[node[met]], rep[root[met]]))
        some = np.flatnonzero(n)
        e = [np.concatenate([p[k] for p in edges]) if edges else np.empty(0, np.int64) for k in (0, 1)]
        return np.append(rep[some], e[0]), np.append(rep[some], e[1]), np.append(n[some], np.zeros(len(e[0]), np.int64))

    key = ["label", "dim", "t", "s", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last group may go on in the next batch; it has two blocks' rows at most
        for b in itertools.chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            parts = [x for x in (rest, b and pa.Table.from_batches([b])) if x is not None]
            if not parts:
                return
            now = pa.concat_tables(parts)
            codes = np.stack([pc.rank(now.column(c).combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) for c in key])
            heads = np.append(0, np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1)
            ends = np.append(heads[1:], now.num_rows)
            if b is not None:
                rest, heads, ends = now.slice(heads[-1]), heads[:-1], ends[:-1]
            got = [links(now.slice(lo, hi - lo)) for lo, hi in zip(heads, ends) if hi - lo > 1]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in got])) for k in range(3)], names=["a", "b", "n"])

    together = moved.repartition(*key).sortWithinPartitions(*key)
    found = materialize(together.mapInArrow(run, "a long, b long, n long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("a <> b")).withColumnRenamed("node", "rep")
    classed = classes.join(counts, "rep", "left").join(roots, "rep", "left").select("rep", "label", "v", "least", "mult", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rep").alias("root"))
    whole = materialize(classed, "classes")
    discard(classes, signed, found)
    classed = whole
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classed.join(least, "root").select("label", "v", (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = fit.select("id", "label", "v").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
