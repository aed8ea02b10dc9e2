"""Packing of tokenised documents by shortest-pack-first over the length histogram.

1. Each text is tokenised (public byte-level BPE; the vocabulary's added token is
   matched in texts unless ``special`` is false), closed by id 0, and cut into
   pieces of at most ``capacity`` ids.
2. The histogram of piece lengths, at most ``capacity`` numbers whatever the
   corpus, is packed: lengths longest first, each into the pattern with the most
   room (the shortest pack) that still fits, updating the patterns' counts.
3. Patterns are joined back to pieces by rank within a length.  Ranks are
   counted within salted sub-groups and shifted by their running totals, so that
   a length that half of all pieces share is not one task.

Defined cases: a null text is an empty one (the single id 0); repeated rows are
packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tokenizer_path


class Tokenize:
    """Texts to ids of the public byte-level BPE, each closed by id 0.

    The ranks of ``byte_bpe_50k.tiktoken`` are the vocabulary and the merges of
    ``byte_bpe_50k.json``; the ids are equal (tests compare them), and this reader
    takes a quarter of the time.  The file's added token is matched in texts, as
    ``tokenizers`` does; ``special=False`` reads it as ordinary text.
    """

    SPECIAL = {"<|endoftext|>": 50256}

    def __init__(self, path: str | None = None, special: bool = True) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.SPECIAL if special else {})

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.append(self.model.encode_to_numpy(t, allowed_special="all", disallowed_special=()).astype("<u4"), np.uint32(0)) if t else np.zeros(1, "<u4") for t in texts]


def pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    with_ids: bool = True,
    tokenizer: str | None = None,
    special: bool = True,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``, a row per piece."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = Tokenize(tokenizer, special)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for k, got in enumerate(tokenize(texts[lo : lo + 256]), lo):
                    for s in range(0, len(got), capacity):
                        own = got[s : s + capacity]
                        row.append(k)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        total.append(len(got))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                columns = [b.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in placing order) and how many packs have each.

    Goes over the histogram only: longest lengths first; each batch of equal
    lengths goes to the packs with the most room left, a pattern splitting when
    only some of its packs take one.
    """
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # space left -> patterns
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if s >= length and room[s]), default=None)
            if space is None:
                each = 1
                room[capacity - length * each].append(([length], left))
                left = 0
                continue
            pattern, count = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(count, left)
            if used < count:
                room[space].append((pattern, count - used))
            room[space - length].append(([*pattern, length], used))
            left -= used
    return [p for s in sorted(room) for p in room[s]]


def pack(found: DataFrame, *, capacity: int = 1024, rows_per_rank_group: int = 100_000, broadcast_rows: int = 50_000) -> DataFrame:
    """``found`` (columns of :func:`pieces`) with ``sequence_id`` and ``offset``.

    ``found`` is read more than once: give a written table or one that is cheap
    to make again and the same each time.
    """
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    patterns = shortest_pack_first(histogram, capacity)
    # slots: the ranks [rank0, rank0 + n) of a length go, in order, to the packs of one pattern at one offset
    rows, rank, first = [], defaultdict(int), 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], rank[length] + n, first, offset))
            rank[length] += n
            offset += length
        first += n
    slots = spark.createDataFrame(rows, "length long, rank0 long, rank1 long, first long, offset long")
    # a bounded table: each length placed makes at most two patterns, of at most capacity / length slots
    salts = max(1, -(-max(histogram.values(), default=0) // rows_per_rank_group), min(64, sum(histogram.values()) // 1000))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("length", "salt", "sum(n) over (partition by length order by salt rows between unbounded preceding and current row) - n as before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, start, ids_crc32) - 1 as r").join(before, ["length", "salt"]).selectExpr("*", "r + before as rank").drop("r", "before")
    # ranges of ranks per length: found by position in the sorted array of their ends
    ends = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank1", "rank0", "first", "offset"))).alias("s"))
    if len(rows) <= broadcast_rows:
        placed = ranked.join(F.broadcast(ends), "length")
    else:  # a length that most pieces share meets its slots in as many tasks as it was ranked in
        placed = ranked.join(ends.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["length", "salt"])
    at = placed.select("*", F.filter("s", lambda x: x["rank1"] > F.col("rank"))[0].alias("slot")).drop("s", "salt")
    return at.select(*found.columns, (F.col("slot.first") + F.col("rank") - F.col("slot.rank0")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, with_ids: bool = False, tokenizer: str | None = None, special: bool = True) -> DataFrame:
    """Pieces of all documents and their places; with ``with_ids`` also the ids themselves."""
    return pack(materialize(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids, tokenizer=tokenizer, special=special), "pieces", batch_rows=2000), capacity=capacity)
