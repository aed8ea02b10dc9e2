"""Source divergence, token counts and tokenizer alignment against plain versions and on odd input."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.llm import align, audit, tokencount
from lumiframe.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n int, at string, row int, n_tokens string"
WORDS = ["the", "house", "is", "Red", "and", "green", "trees", "stand", "near", "water", "Überall", "日本", "naïve"]
ODD = [None, "", " ", "  two  spaces ", "\n\t\x00\x1f", "x", "a" * 3000, "!!! ??? 123 ²", "<|endoftext|>a<|endoftext|> b <|endoftext|>", "<|endoftext", "▁", "a▁b", "é é ﬁ Ａ 漢字 😀", "don't we'll 'S", "long word " * 2000, "՘࢏ \U000323b0"]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, 1, "x", 2, "y") for k, t, lang, source in rows], DOCS)


def some_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lang = ["en", "de", None][int(rng.integers(3))]
        source = None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"s{rng.integers(5)}"
        rows.append((k, " ".join(rng.choice(WORDS, int(rng.integers(0, 40)), p=np.arange(13, 0, -1) / 91)), lang, source))
    return rows + [(1000 + k, t, "en", "odd") for k, t in enumerate(ODD)] + [rows[0], (None, "the the house", "fr", ""), (None, None, None, None)]


# ---------------------------------------------------------------- source divergence


def brute_divergence(rows, min_docs, top, a=5, scale=10**9):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, groups, docs = Counter(), defaultdict(Counter), defaultdict(set)
    for k, (_, t, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(upper))
        groups[lang, source].update(words)
        for w in words:
            docs[lang, w].add(k)
    out = []
    kept = defaultdict(list)
    for (lang, w), own in docs.items():
        if len(own) >= min_docs:
            kept[lang].append(w)
    for (lang, _), c in groups.items():
        for w in kept[lang]:
            held[lang, w] += c[w]
    price = lambda c, n, v: 1 + scale * (c + a) // (n + a * v)
    for (lang, source), c in groups.items():
        v = len(kept[lang])
        mine = {w: price(c[w], sum(c[x] for x in kept[lang]), v) for w in kept[lang]}
        whole = {w: price(held[lang, w], sum(held[lang, x] for x in kept[lang]), v) for w in kept[lang]}
        pairs = []
        for (other, item), d in groups.items():
            if other == lang and item != source:
                n = sum(d[x] for x in kept[lang])
                pairs.append((sum(abs(mine[w] - price(d[w], n, v)) for w in kept[lang]), item))
        terms = [(mine[w] - whole[w], w) for w in kept[lang] if c[w] and mine[w] > whole[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[: None if part == "pair" else top])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "min_docs", "top"), [(0, 3, 4), (1, 10, 50), (2, 30, 50), (3, 1000, 50)])
def test_divergence_equals_the_sum_over_all_terms(spark, seed, min_docs, top):
    rows = some_rows(seed)
    got = audit.divergence(frame(spark, rows), min_docs=min_docs, top_terms=top)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, min_docs, top)


def test_shares_are_exact_beyond_64_bits(spark):
    c, n, v = 2**40 + 12345, 2**41 + 777, 10**6
    got = spark.range(1).select(F.lit(c).alias("c"), F.lit(n).alias("n"), F.lit(v).alias("v")).select(audit.share("c", "n", "v", 5, 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_divergence_of_nothing(spark):
    assert audit.divergence(frame(spark, [])).collect() == []
    one = audit.divergence(frame(spark, [(1, None, None, None), (2, "a b", "", "x")]), min_docs=2).collect()
    assert sorted(tuple(r) for r in one) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_divergence_makes_no_row_of_an_absent_term(spark):
    """Sources of words of their own: the overlap join stays as large as what overlaps."""
    rows = [(k, f"common {'w' * (k % 8 + 1)}{'abcdefgh'[k % 8]}", "en", f"s{k % 8}") for k in range(80)]
    postings = audit._postings(frame(spark, rows).select("lang", "source", "text"), 2)
    assert postings.count() == 16  # eight of the common word, and each source's own
    assert sorted(tuple(r) for r in audit.divergence(frame(spark, rows), min_docs=2).collect()) == brute_divergence(rows, 2, 50)


# ---------------------------------------------------------------- token counts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize(("frequent", "summary", "cached"), [(65_536, 4096, 100_000), (5, 2, 3), (0, 1, 1)])
def test_counts_are_the_librarys(spark, monkeypatch, frequent, summary, cached):
    monkeypatch.setattr(tokencount, "_CACHED", cached)
    rows = some_rows(5)
    got = tokencount.count_tokens(frame(spark, rows), frequent=frequent, summary=summary, limit=20).collect()
    encode = library()
    want = [(k, len((t or "").encode()), n := len(encode.encode(t or "", add_special_tokens=False)), n > 20) for k, t, _, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokencount.count_tokens(frame(spark, [])).collect() == []


def test_caches_are_bounded_and_forget_nothing_that_counts(monkeypatch):
    monkeypatch.setattr(tokencount, "_CACHED", 7)
    tokenizer = tokencount.PreTokenizer(tokenizer_path("byte_bpe_50k.json"))
    recent = [{}, {}]
    lookup = tokencount.Lookup({" the": 1}, tokenizer, recent)
    rng = np.random.default_rng(0)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abcdeé'1 \n"), 6)) for _ in range(8)) + " the end" for _ in range(3)]
        assert lookup.counts(texts) == tokenizer.lengths(texts)
        assert max(map(len, recent)) <= 7


def test_every_character_is_cut_as_the_library_cuts_it():
    """After a letter, a digit, a sign and a space; what the pattern engine may class otherwise goes to the library whole."""
    tokenizer = tokencount.PreTokenizer(tokenizer_path("byte_bpe_50k.json"))
    chars = [c for k in range(0x110000) if not 0xD800 <= k < 0xE000 and not tokenizer.odd.match(c := chr(k))]
    assert len(chars) > 100_000 and sum(unicodedata.category(c) == "Lo" for c in chars) > 80_000
    assert all(tokenizer.is_odd(f"ä{chr(k)}") == bool(tokenizer.odd.match(chr(k))) for k in [*range(0x300, 0x3000), 0x1F600, 0x2FFFF, 0x30000, 0x10FFFF])
    cut = tokenizer.model.pre_tokenizer.pre_tokenize_str
    for lo in range(0, len(chars), 5000):
        text = "".join(f"a{c}1{c}!{c} {c}\n" for c in chars[lo : lo + 5000])
        assert [len(x) for x in tokenizer.find(text)] == [e - s for _, (s, e) in cut(text)]


def test_ascii_texts_are_cut_alike_by_both_engines():
    tokenizer = tokencount.PreTokenizer(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    chars = [chr(k) for k in range(128)] + list("  ''stmdrevl\n\t")
    for _ in range(2000):
        text = "".join(rng.choice(chars, int(rng.integers(0, 30))))
        assert tokencount._ASCII.findall(text) == tokenizer.find(text) == [text[s:e] for _, (s, e) in tokenizer.model.pre_tokenizer.pre_tokenize_str(text)]


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.PreTokenizer(tokenizer_path("word_bpe_49k.json"))


# ---------------------------------------------------------------- tokenizer alignment


def byte_alphabet():
    """The characters that stand for bytes in the entries of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_alignment(rows):
    import sentencepiece

    alphabet = byte_alphabet()
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        entry = {n: bytes(map(alphabet.__getitem__, w)) for w, n in json.load(f)["model"]["vocab"].items()}
    a_model = library()
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    each, held = [], Counter()
    for k, t, _, _ in rows:
        groups, links = [], []
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
            x, y = [entry[n] for n in a], [piece(b_model.id_to_piece(n)) for n in b]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                spans = [[(sum(map(len, z[:i])), sum(map(len, z[: i + 1]))) for i in range(len(z))] if len(z) < 200 else list(zip(np.cumsum([0, *map(len, z)]).tolist(), np.cumsum([*map(len, z)]).tolist())) for z in (x, y)]
                cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
                low = 0
                for end in sorted(cuts):
                    groups.append(tuple([n for n, (s, e) in zip(own, span) if low <= s and e <= end] for own, span in zip((a, b), spans)))
                    low = end
                if len(a) < 200:
                    links = [(p, q) for p, (s, e) in zip(a, spans[0]) for q, (u, v) in zip(b, spans[1]) if s < v and u < e]
                else:
                    j = 0
                    for p, (s, e) in zip(a, spans[0]):
                        while spans[1][j][1] <= s:
                            j += 1
                        i = j
                        while i < len(b) and spans[1][i][0] < e:
                            links.append((p, b[i]))
                            i += 1
        held.update(set(links))
        each.append((k, groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for k, groups, links in each:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.mark.parametrize("hot_pairs", [1_000_000, 40, 0])
def test_alignment_equals_the_plain_one(spark, hot_pairs):
    rows = some_rows(7, 80)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 4000] + [(5000, "long words " * 700, None, None)]
    got = align.align_tokenizers(frame(spark, rows), hot_pairs=hot_pairs)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == names
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_alignment(rows)))


def test_alignment_of_nothing(spark):
    assert align.align_tokenizers(frame(spark, [])).collect() == []
    r = align.align_tokenizers(frame(spark, [(3, None, None, None)])).first()
    assert tuple(r) == (3, 0, 0, 0, 0, 0, 0, "")


def test_overlaps_by_bisection():
    """Random cuts of the same bytes against all pairs of intervals."""
    rng = np.random.default_rng(0)
    size = np.arange(9)
    for _ in range(50):
        a, b = [], []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(0, 30))
            for own in (a, b):
                cuts, left = [], n
                while left:
                    cuts.append(int(rng.integers(1, min(8, left) + 1)))
                    left -= cuts[-1]
                own.append(np.array(cuts, np.int32))
        got = align.align(a, b, size, size)
        want, groups = [], []
        for k, (x, y) in enumerate(zip(a, b)):
            ex, ey = np.cumsum(x), np.cumsum(y)
            want += [(k, int(p), int(q)) for e, p in zip(ex, x) for f, q in zip(ey, y) if e - p < f and f - q < e]
            groups.append(len(set(ex) & set(ey)))
        pair, text = got.links()
        assert list(zip(text.tolist(), (pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist())) == want
        assert np.diff(got.g0).tolist() == groups


def test_slices_are_bounded_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(align, "_CHARS", 50)
    monkeypatch.setattr(align, "_HELD", 20)
    rows = some_rows(9, 40)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 4000]
    got = align.align_tokenizers(frame(spark, rows), hot_pairs=20)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_alignment(rows)))
