"""Benchmark decontamination with DataFrame expressions only.

A document holds a benchmark item if any *item-sized window* of its words has a
weighted-shingle (multiset) Jaccard similarity of ``similarity`` or more with it.

1. Words are runs of letters and digits, lower case; shingles are ``words`` of
   them in a row (items with fewer words: the whole item).
2. Pairs: a window similar to an item shares at least one of any ``m -
   ceil(similarity * m) + 1`` of the item's ``m`` shingles.  One scan of the corpus
   finds the documents that hold one of those which fewest items have, and pairs them
   with these items alone: what many items share (a template) pairs nothing.
3. Windows of each pair: moving a window on to the next shared shingle loses none that
   it shares, so the windows that open with *any* shingle shared with the item (or
   close the document) hold a best one.  Those with too few shared shingles to be
   similar are left out.  Positions are compared by rank in a join; documents are cut
   into tiles of ``tile`` shingles, so that a very long one is not one row.
4. Shingles that recur in a window are numbered: the first is itself, the others are
   hashed with their number.  So multisets become sets of elements with hashes of
   their own, and each window and item gets a 64-bit SimHash of its set.  Multi-index
   blocks: eight blocks of eight bits, each matched within two bits, hold every pair
   within ``radius`` (23 at most) by the pigeonhole principle.
5. Candidates within the radius are verified by exact weighted-shingle similarity,
   which is the Jaccard similarity of the numbered sets.

At the default similarity two fingerprints differ in 10 bits of 64 on average,
standard deviation 3; the radius of 23 is over four of them away.  Texts that repeat
themselves are no exception, since every element has a hash of its own.

Defined cases: null and empty texts hold nothing and are held by nothing;
repeated rows of one id count once; null ids are an id of their own; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, with_row_key

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def shingles_of(words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words, in order; none if there are fewer words."""
    # bound as a lambda variable, so that the splitting runs once a row
    each = lambda w: F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(words), each), F.lit(0))


def simhash(shingles: str) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if it is set in over half of them."""
    return F.expr(
        f"""aggregate(sequence(0, 63), 0L, (_sum, _bit) ->
            _sum | if(2 * aggregate({shingles}, 0L, (_n, _h) -> _n + (shiftright(_h, _bit) & 1L)) > size({shingles}), shiftleft(1L, _bit), 0L))"""
    )


def numbered(shingles: str) -> Column:
    """A multiset of hashes as a set: of equal ones the first stays, the k-th after it is hashed with k."""
    place = "(_at + 1 - cast(array_position(_s, _h) as int))"
    return F.expr(f"transform(array(array_sort({shingles})), _s -> transform(_s, (_h, _at) -> if({place} = 0, _h, xxhash64(_h, {place}))))[0]")


def weighted_jaccard(a: str, b: str) -> Column:
    """Of two :func:`numbered` multisets: sum of the smaller counts over sum of the larger."""
    return F.expr(f"transform(array(size(array_intersect({a}, {b}))), _n -> _n / (size({a}) + size({b}) - _n))[0]")


def _by_size(column: str, sizes: list[int]) -> Column:
    """Shingles of the words in ``column``, by the row's ``size``."""
    s = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in sizes:
        s = s.when(F.col("size") == k, shingles_of(F.col(column), k))
    return s


def benchmark_items(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``(key, item, n, size, s)``: a row key, word count, shingle size and shingles of each item that has words."""
    split = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    split = split.select("item", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(words)).alias("size"))
    return split.select(F.monotonically_increasing_id().alias("key"), "item", "n", "size", _by_size("w", list(range(1, words + 1))).alias("s"))


def _pairs(texts: DataFrame, bench: DataFrame, sizes: list[int], similarity: float, small: bool) -> DataFrame:
    """``(k1, k2, key)``: rows of ``texts`` and the items of which they hold a shingle that fewest items have."""
    own = bench.select("key", F.size("s").alias("m"), F.explode("s").alias("h"))
    shared = own.groupBy("h").agg(F.count("*").alias("items"))
    ranked = own.join(shared, "h").selectExpr("key", "h", "row_number() over (partition by key order by items, h) as r", f"m - ceil({similarity} * m - 1e-9) + 1 as prefix")
    anchors = ranked.where("r <= prefix").select("key", "h").distinct()
    words = texts.select("k1", "k2", words_of(F.col("text")).alias("w"))
    hits = words.select("k1", "k2", F.explode(F.concat(*[shingles_of(F.col("w"), k) for k in sizes])).alias("h"))
    return hits.join(F.broadcast(anchors) if small else anchors, "h").select("k1", "k2", "key").distinct()


def _windows(tiles: DataFrame, pairs: DataFrame, items: DataFrame, similarity: float, tile: int) -> DataFrame:
    """``(doc, size, n, m, start)``: the windows of documents that may be similar to an item paired with them."""
    at = tiles.select("doc", "size", "len", "tile", F.posexplode(F.slice("h", 1, tile)).alias("p", "h")).withColumn("pos", F.col("tile") * tile + F.col("p"))
    known = pairs.join(items.select("key", "n", "size", F.size("s").alias("m"), F.array_distinct("s").alias("s")), "key").select("doc", "key", "n", "size", "m", F.explode("s").alias("h"))
    hits = at.join(known, ["doc", "size", "h"]).select("doc", "size", "len", "key", "n", "m", "pos")
    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy("doc", "size", "key").orderBy("pos")))
    # of a window's a shingles and the item's m, at least that many are shared
    need = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (F.least("len", "m") + F.col("m")) - 1e-9)).cast("int")
    first = ranked.select("doc", "size", "key", "n", "m", F.col("pos").alias("first"), F.greatest(F.lit(0), F.col("len") - F.col("m")).alias("latest"), (F.col("r") + need - 1).alias("r"))
    last = ranked.select("doc", "size", "key", "r", F.col("pos").alias("last"))
    both = first.join(last, ["doc", "size", "key", "r"]).withColumn("start", F.least("first", "latest"))
    return both.where("last < start + m").select("doc", "size", "n", "m", "start").distinct()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    radius: int = 23,
    broadcast_rows: int = 200_000,
    tile: int = 1024,
) -> DataFrame:
    """``(id, item, start, n_words, similarity, distance)``: the best window of each document and item."""
    if radius >= BLOCKS * (BLOCK_RADIUS + 1):
        raise ValueError(f"the blocks hold pairs within {BLOCKS * (BLOCK_RADIUS + 1) - 1} bits")
    bench = materialize(benchmark_items(items, id_col=item_col, text_col=item_text_col, words=words), "items")
    facts = {r["size"]: r for r in bench.groupBy("size").agg(F.sum(F.size("s")).alias("n"), F.max(F.size("s")).alias("longest")).collect()}  # ``words`` rows at most
    if not facts:
        kinds = [f"id {docs.schema[id_col].dataType.simpleString()}", f"item {items.schema[item_col].dataType.simpleString()}"]
        return docs.sparkSession.createDataFrame([], ", ".join([*kinds, "start int, n_words int, similarity double, distance int"]))
    sizes, small = sorted(facts), sum(r["n"] for r in facts.values()) <= broadcast_rows
    # 128 bits tell rows apart; rows of one id and text are one document
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit("again")).alias("k2"))
    likely = materialize(_pairs(texts, bench, sizes, similarity, small), "likely")
    # each is cut into overlapping tiles
    one = texts.join(likely.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    chosen = materialize(one.select(F.monotonically_increasing_id().alias("doc"), "k1", "k2", "id", "text"), "chosen")
    split = chosen.select("doc", words_of(F.col("text")).alias("w"), F.explode(F.array(*[F.lit(k) for k in sizes])).alias("size")).select("doc", "size", _by_size("w", sizes).alias("s")).where("size(s) > 0")
    reach = tile + max(r["longest"] for r in facts.values())
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(s) - 1) div {tile}").cast("int")), lambda t: F.struct(t.alias("tile"), F.slice("s", t * tile + 1, F.lit(reach)).alias("h")))
    tiles = materialize(split.select("doc", "size", F.size("s").alias("len"), F.explode(cut).alias("t")).select("doc", "size", "len", "t.tile", "t.h"), "tiles")
    pairs = likely.join(chosen.select("k1", "k2", "doc"), ["k1", "k2"]).select("doc", "key")
    found = _windows(tiles, pairs, bench, similarity, tile).withColumn("tile", F.expr(f"start div {tile}").cast("int"))
    windows = found.join(tiles.select("doc", "size", "tile", "h"), ["doc", "size", "tile"]).select("doc", "size", "start", "n", numbered(f"slice(h, start - tile * {tile} + 1, m)").alias("s"))
    marked = materialize(windows.select("*", simhash("s").alias("fp")), "fingerprints")
    discard(likely, tiles)
    block = lambda k: F.shiftrightunsigned(F.col("fp"), BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), block(k).alias("v")) for k in range(BLOCKS)])
    sets = bench.select("key", "item", "n", "size", numbered("s").alias("s"))
    index = sets.select("key", "n", "size", simhash("s").alias("fp"))
    index = index.select("key", "n", "size", F.col("fp").alias("item_fp"), F.explode(blocks).alias("b")).select(
        "key", "n", "size", "item_fp", F.col("b.block").alias("block"),
        F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), lambda v: F.bit_count(v.bitwiseXOR(F.col("b.v"))) <= BLOCK_RADIUS)).alias("v"),
    )
    probes = marked.select("doc", "start", "n", "size", "fp", F.explode(blocks).alias("b")).select("doc", "start", "n", "size", "fp", "b.block", "b.v")
    close = probes.join(index, ["n", "size", "block", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = close.select("doc", "start", "n", "size", "key", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).distinct()
    whole = pairs.join(marked.select("doc", "start", "n", "size", F.col("s").alias("a")), ["doc", "start", "n", "size"]).join(sets.select("key", "item", F.col("s").alias("b")), "key")
    checked = whole.select("doc", "item", "start", F.col("n").alias("n_words"), weighted_jaccard("a", "b").alias("similarity"), F.col("distance").cast("int").alias("distance")).where(F.col("similarity") >= similarity)
    named = checked.join(chosen.select("doc", "id"), "doc")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words", "distance"))
    out = materialize(named.groupBy("id", "item").agg(best.alias("x")).select("id", "item", (-F.col("x.s")).alias("start"), "x.n_words", "x.similarity", "x.distance"), "contaminated")
    discard(bench, chosen, marked)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with the columns of ``docs``.

    Each row is judged by its own text: rows without an id, or that share one
    (``id_col``), do not stand for each other.
    """
    rows, key = with_row_key(docs, "rows")
    held = contaminated(rows, items, id_col=key, **options).select(F.col("id").alias(key)).distinct()
    return rows.join(held, key, "left_anti").select(*docs.columns)
