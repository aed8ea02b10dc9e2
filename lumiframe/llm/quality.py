"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

A text's words (split at white space) and their shapes (letter case, digits and
marks, runs collapsed) give unigrams and bigrams, hashed into ``2**bits``
slots; a bigram of one word twice is a slot of its own.  Each of the four
families counts as a distribution, so that length does not matter.  Training is
follow-the-regularised-leader over a bounded sample of labelled rows (at most
``max_train_rows`` of them and ``max_train_slots`` slots of features, so that the
one task that makes the sequential updates has bounded memory whatever the texts'
lengths); scoring is a sparse dot product, broadcast weights of fixed size.

Defined cases: a null, empty or blank text has no features and gets the score
of the bias alone; null labels are not learnt from; a document labelled twice
counts twice; without any labelled row every score is 0.5.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_rows, bounded_by_hash, fresh

_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64((7 * 0x9E3779B97F4A7C15) % 2**64)
_SCALE = 8.0
#: Rows of an Arrow batch in training: texts, and features of up to tens of kilobytes.
_BATCH = 256


@dataclass
class QualityModel:
    bits: int
    weights: np.ndarray  # float32, 2**bits
    bias: float


def _shape(word: str) -> str:
    out = []
    for ch in word:
        c = "A" if ch.isupper() else "a" if ch.isalpha() else "9" if ch.isdigit() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:12])


class _Words(dict):
    """word -> row of ``hashes``: of the word in lower case and of its shape."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.start()

    def start(self) -> None:
        self.clear()
        self.word, self.shape = array("Q"), array("Q")

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self.word)
        self.word.append(xxhash.xxh64_intdigest(w.lower().encode("utf-8", "replace"), 1))
        self.shape.append(xxhash.xxh64_intdigest(_shape(w).encode("utf-8", "replace"), 2))
        return n


def features(text: str | None, words: _Words, bits: int) -> list[np.ndarray]:
    """The slots of each family of n-grams, repeats included."""
    tokens = (text or "").split()
    if not tokens:
        return []
    if len(words) > _Words.LIMIT:
        words.start()
    ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    a, b = np.frombuffer(words.word, np.uint64)[ids], np.frombuffer(words.shape, np.uint64)[ids]
    shift = np.uint64(64 - bits)
    out = [(a * _MIX) >> shift, (b * _MIX) >> shift]
    if len(a) > 1:
        for h, seed in ((a, 3), (b, 5)):
            two = ((h[:-1] * np.uint64(31)) ^ (h[1:] + np.uint64(seed))) * _MIX
            if h is a:
                two[a[:-1] == a[1:]] = _REPEAT
            out.append(two >> shift)
    return out


def _sparse(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    idx = np.concatenate(families)
    val = np.concatenate([np.full(len(f), _SCALE / len(f), np.float32) for f in families])
    u, back = np.unique(idx, return_inverse=True)
    return u.astype(np.int32), np.bincount(back, val).astype(np.float32)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train_rows: int = 16_000,
    max_train_slots: int = 30_000_000,
    bits: int = 18,
    alpha: float = 0.3,
    beta: float = 0.05,
    l1: float = 0.002,
    l2: float = 0.01,
    epochs: int = 3,
) -> QualityModel:
    """Learn from the rows of ``labels``, in the order of a hash, up to the two bounds.

    Features are made where the texts are; one task of bounded input runs the
    sequential updates.  Rows that share an id count each, up to the bounds.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and k is not null")
    # by the id alone, so that the same filter reaches the documents before the join
    known = bounded_by_hash(known, "k", max_train_rows, known.count())
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(known, "k")
    # an id that many rows share is thinned by its texts, so that the task's input is bounded as well
    rows = bounded_by_hash(rows, ["k", "t", "y"], 2 * max_train_rows, rows.select("k").count()).select("k", "y", "t")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            got = [_sparse(f) if (f := features(t, words, bits)) else (np.empty(0, np.int32), np.empty(0, np.float32)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("y"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
                names=["k", "y", "i", "v"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        data, slots = [], 0
        for b in batches:
            for y, i, v in zip(b.column("y").to_pylist(), b.column("i"), b.column("v")):
                i, v = np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)
                slots += len(i)
                if len(data) == max_train_rows or slots > max_train_slots:
                    break
                # the last slot is the bias
                data.append((y, np.append(i, np.int32(1 << bits)), np.append(v, np.float32(1))))
        bias = np.int32(1 << bits)

        def weight(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
            return np.where((np.abs(zi) <= l1) & (i != bias), 0.0, w)

        for _ in range(epochs):
            for y, i, x in data:
                w = weight(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * w
                n[i] += g * g
        w = weight(np.arange((1 << bits) + 1))
        yield pa.RecordBatch.from_pydict({"w": [w[:-1].astype(np.float32).tobytes()], "b": [float(w[-1])]})

    kept = rows.mapInArrow(sparse, "k long, y int, i binary, v binary" if dict(rows.dtypes)["k"] == "bigint" else T.StructType([rows.schema["k"], T.StructField("y", T.IntegerType()), T.StructField("i", T.BinaryType()), T.StructField("v", T.BinaryType())]))
    with arrow_rows(docs.sparkSession, _BATCH):
        got = kept.repartition(1).sortWithinPartitions(F.xxhash64("k"), "k").mapInArrow(train, "w binary, b double").collect()
    if not got:
        return QualityModel(bits, np.zeros(1 << bits, np.float32), 0.0)
    return QualityModel(bits, np.frombuffer(got[0]["w"], np.float32), got[0]["b"])


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and a column: the probability of label 1, of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bits, model.weights, model.bias))

    def make():
        bits, weights, bias = sent.value
        words = _Words()

        def run(texts: pa.Array) -> list[pa.Array]:
            margin = np.full(len(texts), bias)
            for k, t in enumerate(texts.to_pylist()):
                margin[k] += sum(float(weights[f].mean()) * _SCALE for f in features(t, words, bits))
            return [pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))), pa.float64())]

        return run

    return append_columns(docs, text_col, [T.StructField(out, T.DoubleType())], make)


def reject_low_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows scored at ``threshold`` or more, with the columns of ``docs``."""
    name = fresh(docs, "_quality")
    return score(docs, model, text_col=text_col, out=name).where(F.col(name) >= threshold).drop(name)
