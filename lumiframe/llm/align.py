"""Alignment of two tokenisers over the same texts, and how often their tokens meet.

A text is encoded by a byte-level BPE (A, with a space before it) and by a piece model
with byte fallback (B, which adds that space itself), without special tokens.  Both
cut the same bytes, so their tokens are intervals:

1. The B tokens' ends and starts, both sorted, are a static interval index.  Each A
   token stabs it with its two ends by bisection and gets the range of B tokens that
   it overlaps.  The texts of a slice lie one after another on one line of bytes, so
   one bisection serves them all.
2. A gap between two B tokens that no A token spans is where both end: a group
   boundary.  Spans are counted by a running sum of the ranges' ends.
3. How many documents hold a linked pair of ids: each task sums its documents' distinct
   pairs before they are shuffled.
4. Back to the documents in two tiers.  The most frequent pairs, ``hot_pairs`` at most,
   are broadcast as sorted numbers and met in the task; the others, each in few
   documents since it is infrequent, are joined by pair.  So no frequent pair is ever
   a join key.

Ids are written once, as Parquet in the shared folder; both passes read them.

Defined cases: texts that are null, empty, or that a tokeniser does not give back byte
for byte have no tokens: zeros and ``''``; repeated rows are documents of their own,
ids may be null or shared; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tokenizer_path
from .packing import Tokenize

_TEXTS, _CHARS, _HELD = 256, 4_000_000, 2_000_000
_IDS = "row long, doc_id long, a array<int>, b array<int>"


class Pair:
    """Both tokenisers, and the bytes of their ids."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece

        self.a = Tokenize(a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes, self.b_bytes = bytes_of(a, b)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B; none where one of them does not give the bytes of a space and the text."""
        none = np.empty(0, np.int32)
        out = [(none, none)] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        for k, b in zip(some, self.b.encode([texts[k] for k in some], num_threads=1)):
            spaced = " " + texts[k]
            a, raw = self.a.model.encode_ordinary(spaced), spaced.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                out[k] = np.array(a, np.int32), np.array(b, np.int32)
        return out


@cache
def bytes_of(a: str, b: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of a rank file and of a piece model."""
    import sentencepiece

    with open(a, "rb") as f:
        ranks = {int(n): base64.b64decode(w) for w, n in map(bytes.split, f)}
    model = sentencepiece.SentencePieceProcessor(model_file=b)
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k in range(model.get_piece_size()) for p in [model.id_to_piece(k)]]
    return [ranks.get(k, b"") for k in range(max(ranks) + 1)], pieces


@cache
def _pair(a: str, b: str) -> Pair:
    return Pair(a, b)


@dataclass
class Aligned:
    """Several texts' tokens on one line of bytes.

    ``low``, ``high``: the B tokens [low, high) that each A token overlaps; ``group_a``,
    ``group_b``: the group of each token; the texts' first tokens and groups are in
    ``a0`` and so on, one more than there are texts.
    """

    a: np.ndarray
    b: np.ndarray
    low: np.ndarray
    high: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    a0: np.ndarray
    b0: np.ndarray
    g0: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The pair of ids of each link, and the text that it lies in."""
        n = self.high - self.low
        at = np.repeat(np.arange(len(n)), n)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + self.low[at]
        pair = self.a[at].astype(np.int64) << 32 | self.b[other]
        return pair, np.searchsorted(self.a0, at, "right") - 1

    def texts(self, a_words: np.ndarray, b_words: np.ndarray) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2``; the words are decimal ids, once with each sign that may follow."""
        last = lambda g: np.append(g[1:] != g[:-1], True).astype(int)[: len(g)]
        first_b = np.searchsorted(self.group_b, self.group_a)
        all_a = np.searchsorted(self.group_a, self.group_b, "right")
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + first_b] = a_words[last(self.group_a), self.a]
        out[np.arange(len(self.b)) + all_a] = b_words[last(self.group_b), self.b]
        for s, e in zip(self.a0 + self.b0, (self.a0 + self.b0)[1:]):
            yield b"".join(out[s:e].tolist())[:-1]


def align(a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Tokens of several texts by their overlaps; ``a_size``, ``b_size`` are the lengths of ids in bytes."""
    starts = lambda x: np.cumsum([0, *map(len, x)])
    ids = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (a, b)]
    ends = [np.cumsum(size[i]) for size, i in zip((a_size, b_size), ids)]
    begins = [e - size[i] for e, size, i in zip(ends, (a_size, b_size), ids)]
    low, high = np.searchsorted(ends[1], begins[0], "right"), np.searchsorted(begins[1], ends[0], "left")
    spans = np.bincount(low, minlength=len(ids[1]) + 1) - np.bincount(high - 1, minlength=len(ids[1]) + 1) if len(ids[0]) else np.zeros(1, np.int64)
    free = np.cumsum(spans)[: len(ids[1])] == 0  # after each B token
    group_b = np.cumsum(free) - free
    a0, b0 = starts(a), starts(b)
    g0 = np.append(group_b, free.sum())[b0]
    return Aligned(ids[0], ids[1], low, high, group_b[low], group_b, a0, b0, g0)


def _sizes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in own], np.int64) for own in bytes_of(a, b))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``_TEXTS`` texts, of about ``_CHARS`` tokens where there are several."""
    sizes = batch.column("a").value_lengths().fill_null(0).to_numpy()
    lo = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > lo and (k - lo == _TEXTS or size + n > _CHARS):
            yield batch.slice(lo, k - lo)
            lo, size = k, 0
        size += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _aligned(part: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
    each = []
    for c in ("a", "b"):
        own = part.column(c)
        flat = own.flatten().to_numpy(zero_copy_only=False)
        cuts = np.cumsum(own.value_lengths().to_numpy())[:-1]
        each.append(np.split(flat, cuts))
    return align(*each, *sizes)


def encoded(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, a, b)``: ids of each text by both tokenisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(a, b)
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(lo, _TEXTS)
                ids = both.encode(part.column("text").to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x[k]) for x in ids]]).astype(np.int32)), pa.array(np.concatenate([x[k] for x in ids]), pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *lists], names=["row", "doc_id", "a", "b"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, _IDS)


def pair_counts(ids: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(pair, n)``: how many documents hold each linked pair; a pair is the A id times 2**32 and the B id."""

    def batch(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for part in _slices(b):
                pair, text = _aligned(part, sizes).links()
                known, back = np.unique(pair, return_inverse=True)
                each = np.unique(back.astype(np.int64) * part.num_rows + text) // part.num_rows  # a pair once a text
                held.append((known, np.bincount(each, minlength=len(known)).astype(np.int64)))
                size += len(known)
                if size > _HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield batch(*held[0])
                        held, size = [], 0
        if held:
            yield batch(*merged(held))

    return ids.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _bits(column: str) -> Column:
    return F.length(F.bin(column))


def _most_frequent(counts: DataFrame, hot_pairs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted pairs and their counts, at most ``hot_pairs`` of them, and how many bits a count needs to be among them."""
    by_bits = {r["k"]: r["n"] for r in counts.groupBy(_bits("n").alias("k")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    bits, held = 65, 0
    while bits > 0 and held + by_bits.get(bits - 1, 0) <= hot_pairs:
        bits -= 1
        held += by_bits.get(bits, 0)
    t = counts.where(_bits("n") >= bits).toArrow()
    pair, n = t.column("pair").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(pair)
    return pair[order], n[order], bits


def _words(n: int, inner: bytes, last: bytes) -> np.ndarray:
    out = np.empty((2, n), object)
    out[:] = [[b"%d%s" % (k, s) for k in range(n)] for s in (inner, last)]
    return out


def align_tokenizers(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    a: str | None = None,
    b: str | None = None,
    hot_pairs: int = 1_000_000,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row.

    ``a``: a rank file of a byte-level BPE; ``b``: a piece model.  A link's count is
    how many documents hold its pair of ids linked; ``n_best`` are the links whose
    count is the highest that their A id has.
    """
    a, b = a or tokenizer_path("byte_bpe_50k.tiktoken"), b or tokenizer_path("piece_bpe_32k.model")
    sizes = _sizes(a, b)
    ids = materialize(encoded(docs, a, b, id_col=id_col, text_col=text_col), "ids", batch_rows=1000)
    counts = materialize(pair_counts(ids, sizes), "pair-counts")
    hot, hot_n, bits = _most_frequent(counts, hot_pairs)
    best = np.zeros(len(sizes[0]), np.int64)
    for r in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect():  # a row an id of A at most
        best[r["a"]] = r["n"]
    sent = docs.sparkSession.sparkContext.broadcast((hot, hot_n, best))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, hot_best long, hot_sum long, groups_sha256 string, rest array<struct<pair: long, times: long, best: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n, best = sent.value
        words = _words(len(sizes[0]), b",", b"|"), _words(len(sizes[1]), b",", b";")
        for batch in batches:
            for part in _slices(batch):
                t, k = _aligned(part, sizes), part.num_rows
                pair, text = t.links()
                at = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
                found = hot[at] == pair if len(hot) else np.zeros(len(pair), bool)
                n = hot_n[at[found]]
                total = lambda x, by: np.bincount(by, x, k).astype(np.int64)  # noqa: E731  exact up to 2**53
                sums = np.zeros(k, np.int64)
                np.add.at(sums, text[found], n)
                # infrequent pairs once a text, with how often they occur in it
                left, of = pair[~found], text[~found]
                known, back = np.unique(left, return_inverse=True)
                each, times = np.unique(of.astype(np.int64) * max(len(known), 1) + back, return_counts=True)
                of, left = each // max(len(known), 1), known[each % max(len(known), 1)] if len(known) else known
                rest = pa.StructArray.from_arrays([pa.array(left), pa.array(times.astype(np.int64)), pa.array(best[left >> 32])], names=["pair", "times", "best"])
                digests = [hashlib.sha256(s).hexdigest() if s else "" for s in t.texts(*words)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), *[pa.array(np.diff(x).astype(np.int64)) for x in (t.a0, t.b0, t.g0)], pa.array(np.bincount(text, minlength=k).astype(np.int64)),
                        pa.array(total(n == best[pair[found] >> 32], text[found])), pa.array(sums), pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(k + 1)).astype(np.int32)), rest),
                    ],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "hot_best", "hot_sum", "groups_sha256", "rest"],
                )

    part = materialize(ids.mapInArrow(run, schema), "aligned", batch_rows=1000)
    discard(ids)
    asked = part.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    met = asked.join(counts.where(_bits("n") < bits), "pair")
    summed = met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = lambda x: (F.col(f"hot_{x}") + F.coalesce(F.col(f"more_{x}"), F.lit(0))).cast("long")
    out = materialize(part.join(summed, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", both("best").alias("n_best"), both("sum").alias("count_sum"), "groups_sha256"), "alignment")
    discard(part, counts)
    return out
