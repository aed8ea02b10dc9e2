"""Language identification by segmentation-marginalised unigrams.

The pieces are the lower-case letter pieces of a fixed public vocabulary
(sentencepiece BPE, 32k).  Each language has a probability for each piece,
learnt by expectation-maximisation; a word's probability is the *sum over all
its segmentations* of the product of its pieces' probabilities, which the
forward algorithm computes for all languages at once.  A text is the run of its
words (letters only, lower case, each opened by the word mark).

A piece's probability is ``1 - background`` of its learnt share and ``background``
of a uniform one, so a piece that training never saw is worth the same in every
language.  Words without any letter that training saw are evidence for none.

Training takes a bounded sample of each language's labelled texts
(``max_train_docs`` a language, of the ``max_languages`` most frequent labels, so
that the model has a fixed size whatever the labels hold); every text is scored
whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; so
is every text if nothing could be learnt.  A text with letters but no evidence
(unlearnt scripts) gets the first language with score 1 / number of languages;
:func:`keep_known_language` rejects texts most of whose words are no evidence.  A run of over 32 letters is read as
runs of 32: each letter of a run is worth at least the background share, so no
product underflows.  Letters outside the vocabulary go through one unknown piece
of fixed probability.  Ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, discard, fresh, materialize, tokenizer_path

_RUN = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_LONGEST = 32
_UNKNOWN = 1e-7
_PER_CHAR = 5.0  # each letter is worth e**-5 or so; taken out so that no product underflows


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # [piece, language]
    letters: frozenset[str]  # that training saw


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of lower-case letters, with or without the word mark, and the mark itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
    out = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    return sorted({p for p in out if (q := p.removeprefix(_MARK)) == "" and p or q.isalpha() and q == q.lower()} | {_MARK})


class _Lattice:
    """All pieces in words, and the sums over their segmentations."""

    def __init__(self, pieces: list[str]) -> None:
        self.find = ahocorasick.Automaton()
        for k, p in enumerate(pieces):
            self.find.add_word(p, k)
        self.find.make_automaton()
        self.length = np.array([len(p) for p in pieces] + [1], np.int64)  # the last: unknown letter
        self.single = {p for p in pieces if len(p) == 1}

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start node, end node and piece of each arc, by end within its word; the words' first nodes."""
        text = "".join([f"{_MARK}{w}\n" for w in words])
        got = np.fromiter((x for pair in self.find.iter(text) for x in pair), np.int64)
        end, piece = got[0::2] + 1, got[1::2]
        odd = [c for c in set(text) if c not in self.single and c != "\n"]
        if odd:
            at = np.flatnonzero(np.isin(np.frombuffer(text.encode("utf-32-le"), np.uint32), [ord(c) for c in odd]))
            end, piece = np.append(end, at + 1), np.append(piece, np.full(len(at), len(self.length) - 1))
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        depth = end - first[np.searchsorted(first, end - 1, "right") - 1]
        order = np.lexsort((end, depth))
        end, piece = end[order], piece[order]
        return end - self.length[piece], end, piece, first

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log P(word), [word, language]."""
        start, end, piece, first = self.arcs(words)
        p = np.vstack([probs, np.full((1, probs.shape[1]), _UNKNOWN)]) * np.exp(_PER_CHAR * self.length)[:, None]
        alpha, last = self._sums(start, end, p[piece], first, words)
        return np.log(alpha[last]) - _PER_CHAR * (last - first)[:, None]

    def _sums(self, start, end, weight, first, words):
        last = first + np.array([len(w) + 1 for w in words], np.int64)
        alpha = np.zeros((int(last[-1]) + 1, weight.shape[1]))
        alpha[first] = 1.0
        depth = end - first[np.searchsorted(first, end - 1, "right") - 1]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(end))):
            e = end[lo:hi]
            v = alpha[start[lo:hi]] * weight[lo:hi]
            heads = np.append(0, np.flatnonzero(np.diff(e)) + 1)
            alpha[e[heads]] = np.add.reduceat(v, heads, axis=0)
        return alpha, last

    def expected(self, words: list[str], count: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (one language), by forward and backward sums."""
        start, end, piece, first = self.arcs(words)
        p = np.append(probs, _UNKNOWN) * np.exp(_PER_CHAR * self.length)
        w = p[piece]
        alpha, last = self._sums(start, end, w[:, None], first, words)
        alpha = alpha[:, 0]
        beta = np.zeros_like(alpha)
        beta[last] = 1.0
        order = np.lexsort((start, -(start - first[np.searchsorted(first, start, "right") - 1])))
        s, e, x = start[order], end[order], w[order]
        depth = s - first[np.searchsorted(first, s, "right") - 1]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(s))):
            v = beta[e[lo:hi]] * x[lo:hi]
            heads = np.append(0, np.flatnonzero(np.diff(s[lo:hi])) + 1)
            beta[s[lo:hi][heads]] = np.add.reduceat(v, heads)
        word = np.searchsorted(first, end - 1, "right") - 1
        use = alpha[start] * w * beta[end] / alpha[last][word] * count[word]
        return np.bincount(piece, use, len(p))[:-1]


_LATTICES: dict[int, _Lattice] = {}


def _lattice(pieces: list[str]) -> _Lattice:
    key = hash(tuple(pieces))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = _Lattice(pieces)
    return _LATTICES[key]


def words_of(text: str | None) -> list[str]:
    runs = _RUN.findall((text or "").lower())
    if any(len(r) > _LONGEST for r in runs):
        runs = [r[k : k + _LONGEST] for r in runs for k in range(0, len(r), _LONGEST)]
    return runs


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train_docs: int = 4_000,
    max_languages: int = 256,
    rounds: int = 3,
    background: float = 1e-3,
    vocabulary_path: str | None = None,
) -> LanguageModel:
    """Learn piece probabilities from texts whose ``lang_col`` is not null.

    Of each language about ``max_train_docs`` texts at most, chosen by a hash of id
    and text; of over ``max_languages`` labels the most frequent are learnt.
    """
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and k is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()  # max_languages rows
    keep = F.lit(False)
    for r in sizes:
        keep = keep | ((F.col("lang") == r["lang"]) & (F.col("at") < min(1 << 30, int(max_train_docs / r["n"] * (1 << 30)))))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("k", "t", F.lit("sample")), F.lit(1 << 30))).where(keep).drop("at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t").to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(t))
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # max_languages rows at most
    # as many rows as there are letters at most
    letters = frozenset(r[0] for r in counts.select(F.explode(F.split("word", ""))).distinct().collect())
    probs = {lang: np.full(len(pieces), 1 / len(pieces)) for lang in languages}
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast((pieces, probs))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, probs = sent.value
            lattice = _lattice(pieces)
            total = {lang: np.zeros(len(pieces)) for lang in probs}
            for b in batches:
                langs = np.array(b.column("lang").to_pylist(), object)
                words = b.column("word").to_pylist()
                n = b.column("n").to_numpy()
                for lang in probs:
                    own = [(x, n[k]) for k in np.flatnonzero(langs == lang) if (x := _letters(words[k]))]
                    for k in range(0, len(own), 20_000):
                        part = own[k : k + 20_000]
                        total[lang] += lattice.expected([w for w, _ in part], np.array([c for _, c in part], float), probs[lang])
            for lang, t in total.items():
                i = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i), pa.array(t[i])], names=["lang", "piece", "n"])

        # a row for each language and piece of the fixed vocabulary, whatever the corpus
        got = counts.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        for lang in languages:
            own = got[got["lang"] == lang]
            c = np.zeros(len(pieces))
            c[own["piece"].to_numpy()] += own["n"].to_numpy()
            share = c / c.sum() if c.any() else np.full(len(pieces), 1 / len(pieces))
            probs[lang] = (1 - background) * share + background / len(pieces)
        sent.unpersist()
    discard(counts)
    return LanguageModel(languages, pieces, np.array([probs[x] for x in languages]).T if languages else np.zeros((len(pieces), 0)), letters)


class _Scores(dict):
    """word -> row of ``log``; a bounded cache."""

    LIMIT = 300_000

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n

    def start(self, k: int) -> None:
        self.clear()
        self.new: list[str] = []
        self.log = np.zeros((0, k))

    def fill(self, lattice: _Lattice, model: LanguageModel) -> None:
        if self.new:
            words = [_letters(w) for w in self.new]
            probs = model.probs
            log = np.zeros((len(words), probs.shape[1]))
            full = [k for k, w in enumerate(words) if not model.letters.isdisjoint(w)]
            for k in range(0, len(full), 20_000):
                own = full[k : k + 20_000]
                log[own] = lattice.forward([words[i] for i in own], probs)
            self.log = np.vstack([self.log, log])
            self.new = []


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", evidence_out: str | None = None) -> DataFrame:
    """``docs`` and two columns: the language of each whole text and its posterior probability.

    ``evidence_out`` adds a third: the share of its words that have a learnt letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), *([T.StructField(evidence_out, T.DoubleType())] if evidence_out else [])]

    def make():
        m = sent.value
        lattice, cache = _lattice(m.pieces), _Scores()
        cache.start(len(m.languages))

        def run(texts: pa.Array) -> list[pa.Array]:
            langs: list[str] = []
            scores: list[float] = []
            shares: list[float] = []
            texts = texts.to_pylist()
            for lo in range(0, len(texts), 500):
                if len(cache) > _Scores.LIMIT:
                    cache.start(len(m.languages))
                ids = []
                for t in texts[lo : lo + 500]:
                    w = words_of(t) if m.languages else []
                    lettered = any(map(_letters, w))
                    ids.append(np.fromiter(map(cache.__getitem__, w), np.int64, len(w)) if lettered else None)
                cache.fill(lattice, m)
                for i in ids:
                    if i is None:
                        langs.append("und")
                        scores.append(0.0)
                        shares.append(0.0)
                        continue
                    log = cache.log[i]
                    total = log.sum(0)
                    shares.append(float((log[:, 0] != 0).mean()))
                    best = int(total.argmax())
                    langs.append(m.languages[best])
                    scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())][: len(fields)]

        return run

    return append_columns(docs, text_col, fields, make)


def keep_known_language(docs: DataFrame, model: LanguageModel, *, min_score: float = 0.5, min_evidence: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with ``min_score`` or more, with the columns of ``docs``.

    ``min_evidence`` of a text's words have a letter that training saw.
    """
    lang, prob, share = (fresh(docs, n) for n in ("_lang", "_prob", "_share"))
    found = predict(docs, model, text_col=text_col, lang_out=lang, score_out=prob, evidence_out=share)
    return found.where((F.col(lang) != "und") & (F.col(prob) >= min_score) & (F.col(share) >= min_evidence)).drop(lang, prob, share)
