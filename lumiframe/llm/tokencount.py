"""Token counts by lookup: how many tokens each text has, without encoding it.

A byte-level BPE first cuts a text into pre-tokens (words with the space before them,
runs of digits, of other signs, of white space) and merges within each.  So a text's
count is the sum over its pre-tokens, and a pre-token's never changes.

1. One pass over all texts finds frequent pre-tokens.  Each task keeps a bounded
   summary (Misra-Gries by batches) and sends its ``summary`` most frequent ones;
   pre-tokens themselves are never shuffled.  The ``frequent`` best of the summed
   summaries are encoded once.
2. First tier: those and their numbers of tokens, broadcast as one blob; at most
   ``frequent`` entries of at most ``_SHORT`` characters, whatever the corpus.
3. Second tier: what is not there is encoded by the library, a batch's misses
   together, and kept in the Python worker in two generations of ``_CACHED`` entries:
   a full one replaces the one before it.  Longer pre-tokens are encoded each time.

The tiers only save time: every number comes from the library.  Its added tokens
(``<|endoftext|>``) are matched in texts as it does by default, each one token.  Texts
with characters that this machine's pattern engine may class otherwise than the
library, being newer than its tables, are given to the library whole.

Defined cases: a null text is an empty one (no bytes, no tokens); repeated rows are
counted each; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

_SHORT, _CACHED, _SLICE = 64, 100_000, 512
#: From the first character on that Python's tables leave unassigned; one range is searched much faster than many.
_HIGH = re.compile("[\u0378-\U0010ffff]")
#: What the library's pattern is on ASCII texts, for the plain engine, which is three times as fast there.
_ASCII = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")


def _newer() -> re.Pattern:
    """Characters that Python's tables leave unassigned, or of the planes above the second."""
    out, first = [], None
    for k in range(0x30001):
        new = k < 0x30000 and not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) == "Cn"
        if new and first is None:
            first = k
        elif not new and first is not None:
            out.append(f"{chr(first)}-{chr(k - 1)}")
            first = None
    return re.compile(f"[{''.join(out)}{chr(0x30000)}-{chr(0x10FFFF)}]")


class PreTokenizer:
    """The library's cutting of texts, by one pattern, and its encoding."""

    def __init__(self, path: str) -> None:
        import os

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a worker
        with open(path, encoding="utf-8") as f:
            text = f.read()
        said = json.loads(text)
        cut, added = said["pre_tokenizer"] or {}, said["added_tokens"]
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or said["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.model = Tokenizer.from_str(text)
        self.model.no_truncation()
        self.model.no_padding()
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.odd = _newer()

    def is_odd(self, text: str) -> bool:
        """Whether the text holds a character that the library may class otherwise."""
        return not text.isascii() and bool(_HIGH.search(text)) and bool(self.odd.search("".join(set(text))))

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many added tokens stand between them."""
        find = _ASCII.findall if text.isascii() else self.find
        if self.marks is None or not self.marks.search(text):
            return find(text), 0
        parts = self.marks.split(text)
        return list(chain.from_iterable(map(find, parts))), len(parts) - 1

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch(texts, add_special_tokens=False)]


_WORKER: dict[str, PreTokenizer] = {}
_RECENT: dict[str, list[dict[str, int]]] = {}


def _pre_tokenizer(path: str) -> PreTokenizer:
    if path not in _WORKER:
        _WORKER[path] = PreTokenizer(path)
    return _WORKER[path]


class Lookup(dict):
    """First tier; what it lacks is read from the batch's second tier."""

    def __init__(self, table: dict[str, int], tokenizer: PreTokenizer, recent: list[dict[str, int]]) -> None:
        super().__init__(table)
        self.table, self.tokenizer, self.recent, self.now = table, tokenizer, recent, {}

    def __missing__(self, word: str) -> int:
        return self.now[word]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        cut: list[tuple[list[str], int]] = []
        for t in texts:
            whole = t and self.tokenizer.is_odd(t)
            cut.append(([], self.tokenizer.lengths([t])[0]) if whole else self.tokenizer.cut(t) if t else ([], 0))
        young, old = self.recent
        missing = set(chain.from_iterable(words for words, _ in cut)).difference(self.table)
        self.now = {w: n for w in missing if (n := young.get(w) or old.get(w))}
        fresh = [w for w in missing if w not in self.now]
        self.now.update(zip(fresh, self.tokenizer.lengths(fresh)))
        for w, n in self.now.items():
            if len(w) <= _SHORT and w not in young:
                if len(young) >= _CACHED:
                    self.recent[:] = young, old = {}, young
                young[w] = n
        for words, more in cut:
            out.append(sum(map(self.__getitem__, words)) + more)
        return out


def _pack(table: dict[str, int]) -> tuple[bytes, bytes]:
    """A table as one text, its entries parted by NUL (entries that hold one are left to the second tier), and one number each."""
    words = [w for w in table if "\x00" not in w]
    return "\x00".join(words).encode(), np.array([table[w] for w in words], np.uint16).tobytes()


def _unpack(packed: tuple[bytes, bytes]) -> dict[str, int]:
    words = packed[0].decode().split("\x00") if packed[1] else []
    return dict(zip(words, np.frombuffer(packed[1], np.uint16).tolist()))


def frequent_lengths(texts: DataFrame, path: str, frequent: int, summary: int) -> dict[str, int]:
    """The most frequent pre-tokens of the column ``text``, of at most ``_SHORT`` characters, and their numbers of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = _pre_tokenizer(path), Counter()
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                for t in b.column(0).slice(lo, _SLICE).to_pylist():
                    if t:
                        seen.update(tokenizer.cut(t)[0])
                if len(seen) > 16 * summary:
                    # Misra-Gries: what is taken from one is taken from all
                    least = sorted(seen.values())[-4 * summary]
                    seen = Counter({w: n - least for w, n in seen.items() if n > least})
        best = [(w, n) for w, n in seen.most_common(2 * summary) if len(w) <= _SHORT][:summary]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    summed = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r["word"] for r in summed.orderBy(F.col("n").desc(), "word").limit(frequent).collect()]  # ``frequent`` rows at most
    return dict(zip(words, _pre_tokenizer(path).lengths(words)))


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = 1024,
    frequent: int = 65_536,
    summary: int = 4096,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    texts = docs.select(F.col(text_col).alias("text"))
    table = _pack(frequent_lengths(texts, path, frequent, summary))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return own.mapInArrow(_counting(sent, path, limit), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def _counting(sent, path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(_unpack(sent.value), _pre_tokenizer(path), _RECENT.setdefault(path, [{}, {}]))
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                part = b.slice(lo, _SLICE)
                n = np.array(lookup.counts(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run
