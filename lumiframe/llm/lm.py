"""Language-model scoring by deleted interpolation.

Tokens: A-Z lower-cased, runs of bytes outside ASCII white space, then one end
token, which also is the context of a text's first word.  A token's probability
is a mixture of the maximum-likelihood bigram and unigram estimates and a
uniform one over the vocabulary and one unknown word:

    P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

The weights depend on the frequency of the context (buckets of c(v) by powers of
two).  They are learnt by expectation-maximisation on held-out counts: a tenth
of the training texts is scored with the counts of the others.  Final scores
use the counts of all training texts.

How it runs.  Documents are dealt by a hash to blocks of ``block_bytes`` of text.
Each block sends its distinct n-grams, as packed arrays of hashes and counts, to
shards of the hash space (a frequent n-gram comes once from each block); the
shards add up and answer each block's question with the counts.  Blocks and
answers then meet once more, so texts are shuffled twice (a tenth of them, the
held-out ones, a third time).  No n-gram table and no document is ever in one
place.

The bytes that travel are linear in the input: each block's distinct n-grams once, 7
bytes and a count each, and as many counts back.  They are packed in one row for each
block and shard, so rows grow with the product of the two, up to one for each n-gram.
A shard is sized by what it can hold (``shard_bytes`` of packed n-grams).
Both bounds are memory bounds; larger executors take larger blocks and shards
(rows fall with the product of the two).

N-grams are told apart by 64-bit hashes, of which 56 bits and the shard travel.
All counts are 64-bit where they need it.

Defined cases: a null text is an empty one (the end token alone); a null id is
never learnt from and not held out; repeated rows are texts of their own; with
nothing to learn from, every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAIN, HELD, OTHER = 0, 1, 2
BUCKETS = 34
_END = xxhash.xxh64_intdigest(b"", 7)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __init__(self) -> None:
        super().__init__({b"": 0})
        self.hashes = array("Q", [_END])

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(w, 7))
        return n


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` with first places, the number of each and counts; places as 32 bits, and half its memory."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    order = order.astype(np.int32)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    starts = np.flatnonzero(new).astype(np.int32)
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x[starts], order[starts], number, np.diff(starts, append=np.int32(len(x))).astype(np.int64)


def _texts(t: pa.Table) -> Iterator[str | None]:
    """The texts of a table; few of them are Python objects at a time."""
    for b in t.select(["text"]).to_batches(max_chunksize=256):
        yield from b.column(0).to_pylist()


class Block:
    """The n-grams of some texts: tokens ``w`` with contexts ``v``, distinct words and bigrams by hash."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        words, w, sizes = _Words(), array("i"), array("q")
        for t in texts:
            own = (t or "").encode("utf-8", "replace").lower().split()
            own.append(b"")
            w.extend(map(words.__getitem__, own))
            sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        raw = np.array(words.hashes, np.uint64)
        del words  # the texts of the words are not needed again
        order = np.argsort(raw)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words = raw[order]
        self.w = place[np.frombuffer(w, np.int32)] if len(w) else np.empty(0, np.int32)
        del w, raw, order
        # the end token before is the context of a first word
        self.v = np.append(place[:1], self.w[:-1]) if len(self.w) else self.w
        self.word_count = np.bincount(self.w, minlength=len(self.words))
        two = (self.words * _A)[self.v]
        two ^= (self.words * _B)[self.w]
        two ^= two >> np.uint64(29)
        two *= _B
        self.pairs, self.first, self.pair, self.pair_count = _distinct(two)


def _cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted hashes ends."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


#: Rows of packed n-grams that leave Python together, and texts or rows that enter it.
_TOGETHER, _ENTER = 8, 32
#: Bigrams whose probabilities are made at a time.
_SLICE = 1 << 16
_WIDTH = 7  # bytes of a hash that travel; the shard stands for its highest bits


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // _WIDTH, 8), np.uint8)
    out[:, :_WIDTH] = np.frombuffer(packed, np.uint8).reshape(-1, _WIDTH)
    return out.view("<u8").ravel()


def _counts(x: np.ndarray) -> bytes:
    """Counts as four bytes each, or eight if one needs them; the first byte says which."""
    width = 8 if len(x) and x.max() >= 1 << 32 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64) if len(b) else np.empty(0, np.int64)


_ASKED = "shard int, block int, role int, words binary, word_n binary, pairs binary, pair_n binary"
_TOLD = "block int, shard int, words binary, pairs binary, words_main binary, pairs_main binary, n long, v long, n_main long, v_main long"


def _batch(rows: list[tuple], ddl: str) -> pa.Table:
    kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return pa.table({n: pa.array([r[k] for r in rows], kind[t]) for k, (n, t) in enumerate(fields)})


def _together(tables: list[pa.Table], ddl: str) -> pa.Table:
    """Tables of wide rows as one, in which each few stay a batch of their own on the way to the JVM."""
    some = [pa.concat_tables(tables[k : k + _TOGETHER]).combine_chunks() for k in range(0, len(tables), _TOGETHER)]
    return pa.concat_tables(some) if some else _batch([], ddl)


def _ask(shards: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        b = Block(_texts(t))
        cw, cp = _cuts(b.words, shards), _cuts(b.pairs, shards)
        block, role = t.column("block")[0].as_py(), t.column("role")[0].as_py()
        rows = []
        for s in range(shards):
            w, p = slice(cw[s], cw[s + 1]), slice(cp[s], cp[s + 1])
            if w.stop > w.start or p.stop > p.start:
                rows.append(_batch([(s, block, role, _pack(b.words[w]), _counts(b.word_count[w]), _pack(b.pairs[p]), _counts(b.pair_count[p]))], _ASKED))
        return _together(rows, _ASKED)

    return run


def _tell(t: pa.Table) -> pa.Table:
    """One shard: add up, and answer each block in the order in which it asked."""
    role = t.column("role").to_numpy()
    blocks = t.column("block").to_pylist()
    shard = t.column("shard")[0].as_py()
    answers: dict[str, list[bytes]] = {}
    totals = []
    for name, number in (("words", "word_n"), ("pairs", "pair_n")):
        size = np.array([len(x.as_buffer()) // _WIDTH for x in t.column(name)])
        ends = np.cumsum(size)
        asked = np.empty(int(ends[-1]), np.uint64)
        for x, s, e in zip(t.column(name), size, ends):
            asked[e - s : e] = _unpack(x.as_buffer())
        back = _distinct(asked)[2]
        del asked
        count, main = np.zeros((2, int(back.max(initial=-1)) + 1), np.int64)
        for k, (x, s, e) in enumerate(zip(t.column(number), size, ends)):
            if role[k] != OTHER:  # an n-gram stands once in a block
                own, n = back[e - s : e], _numbers(x.as_buffer())
                count[own] += n
                if role[k] == MAIN:
                    main[own] += n
        for key, of in ((name, count), (f"{name}_main", main)):
            answers[key] = [_counts(of[back[e - s : e]]) if key == name or role[k] == HELD else b"" for k, (s, e) in enumerate(zip(size, ends))]
            if name == "words":
                totals += [int(of.sum()), int((of > 0).sum())]
    rows = [_batch([(b, shard, answers["words"][k], answers["pairs"][k], answers["words_main"][k], answers["pairs_main"][k], 0, 0, 0, 0)], _TOLD) for k, b in enumerate(blocks)]
    return _together([*rows, _batch([(-1, shard, b"", b"", b"", b"", *totals)], _TOLD)], _TOLD)


def _joined(t: pa.Table, column: str) -> np.ndarray:
    """A block's answers from all shards, in the order of its sorted hashes."""
    order = np.argsort(t.column("shard").to_numpy())
    got = t.column(column)
    return np.concatenate([_numbers(got[int(k)].as_buffer()) for k in order]) if len(order) else np.empty(0, np.int64)


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.where(context_count > 0, np.minimum(np.frexp(np.maximum(context_count, 1).astype(float))[1], BUCKETS - 1), 0)


def mixture(weights: np.ndarray, p2: np.ndarray, p1: np.ndarray, vocabulary: int) -> np.ndarray:
    """P(word | context), from the context's weights and the two estimates."""
    return weights[:, 0] * p2 + weights[:, 1] * p1 + weights[:, 2] / (vocabulary + 1)


def _parts(context: np.ndarray, word: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return bucket(context), pair / np.maximum(context, 1), word / max(n, 1)


def _em(data: DataFrame, uniform: float, rounds: int) -> np.ndarray:
    """Weights [bucket, (bigram, unigram, uniform)] that make the held-out counts likeliest."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(rounds):
        sent = data.sparkSession.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, 3))
            for b in batches:
                for k, p2, p1, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "p2", "p1", "n"))):
                    k, n = np.frombuffer(k, np.uint8), np.frombuffer(n, "<u4")
                    each = sent.value[k] * np.stack([np.frombuffer(p2, "<f4"), np.frombuffer(p1, "<f4"), np.full(len(k), uniform)], axis=1)
                    each *= (n / each.sum(1))[:, None]
                    for c in range(3):
                        total[:, c] += np.bincount(k, each[:, c], BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *[pa.array(total[:, c]) for c in range(3)]], names=["k", "a", "b", "c"])

        got = data.mapInArrow(expect, "k long, a double, b double, c double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()  # BUCKETS rows
        seen = np.zeros((BUCKETS, 3))
        for r in got:
            seen[r["k"]] = r["a"], r["b"], r["c"]
        seen += weights  # one token's worth, so that a bucket without data keeps its weights
        weights = seen / seen.sum(1, keepdims=True)
    return weights


def score(
    docs: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 20_000_000,
    shard_bytes: int = 16_000_000,
    rounds: int = 8,
) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of each row; counts from rows where ``learn`` holds."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("s")).first()["s"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(-(-size // block_bytes), least)
    # packed n-grams are about as large as the texts
    shards = max(-(-size // shard_bytes), min(least, 12))
    held = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("held")), F.lit(10)) == 0
    role = F.when(~F.coalesce(learn, F.lit(False)), OTHER).when(held, HELD).otherwise(MAIN)
    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role.alias("role"), F.pmod(F.xxhash64(id_col, text_col), F.lit(count)).cast("int").alias("b"))
    # the smaller roles get a tenth of the blocks, so that blocks are about equal
    some = max(1, count // 8)
    block = F.when(F.col("role") == MAIN, F.col("b")).otherwise(F.lit(count) + (F.col("role") - 1) * some + F.col("b") % some).cast("int")
    blocks = each.select("id", "text", "role", block.alias("block"))
    asked = blocks.groupBy("block").applyInArrow(_ask(shards), _ASKED)
    told = materialize(asked.groupBy("shard").applyInArrow(_tell, _TOLD), "counts", batch_rows=_ENTER)
    n, v, n_main, v_main = (x or 0 for x in told.where("block = -1").agg(*[F.sum(c) for c in ("n", "v", "n_main", "v_main")]).first())
    answers = told.where("block >= 0").select("block", "shard", "words", "pairs")
    main = told.where(F.length("words_main") + F.length("pairs_main") > 0).select("block", "shard", F.col("words_main").alias("words"), F.col("pairs_main").alias("pairs"))

    def held_out(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _batch([], "bucket binary, p2 binary, p1 binary, n binary")
        b = Block(_texts(t))
        words, pairs = _joined(a, "words"), _joined(a, "pairs")
        k, p2, p1 = _parts(words[b.v[b.first]], words[b.w[b.first]], pairs, n_main)
        return _batch([(k.astype(np.uint8).tobytes(), p2.astype("<f4").tobytes(), p1.astype("<f4").tobytes(), b.pair_count.astype("<u4").tobytes())], "bucket binary, p2 binary, p1 binary, n binary")

    data = blocks.where(F.col("role") == HELD).groupBy("block").cogroup(main.groupBy("block")).applyInArrow(held_out, "bucket binary, p2 binary, p1 binary, n binary")
    data = materialize(data, "held", batch_rows=_ENTER)
    weights = _em(data, 1 / (v_main + 1), rounds)
    discard(data)

    def final(t: pa.Table, a: pa.Table) -> pa.Table:
        b = Block(_texts(t))
        words, pairs = _joined(a, "words"), _joined(a, "pairs")
        of_pair = np.empty(len(pairs))
        for lo in range(0, len(pairs), _SLICE):
            first, part = b.first[lo : lo + _SLICE], slice(lo, lo + _SLICE)
            k, p2, p1 = _parts(words[b.v[first]], words[b.w[first]], pairs[part], n)
            of_pair[part] = np.log10(mixture(weights[k], p2, p1, v))
        of_word = np.log10((words + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.cumsum(b.sizes) - b.sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        return pa.table({
            "id": t.column("id"), "n_tokens": pa.array(b.sizes), "n_known": pa.array(add((words[b.w] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(b.sizes), n, np.int64)),
            "base_score": pa.array(add(of_word[b.w])), "score": pa.array(add(of_pair[b.pair])),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(final, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
