"""Language ID, quality, SimHash, packing and LM scoring against brute force and on odd input."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumiframe.llm import langid, lm, packing, quality, simhash
from lumiframe.llm.common import crc_mod
from lumiframe.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, fp long"
WORDS = ["the", "house", "is", "red", "and", "green", "trees", "stand", "near", "water", "every", "morning", "light", "falls"]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, "s", 0, 9.0, "x", 1) for i, t, l in rows], DOCS)


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words, n))


ODD = [None, "", "   \n\t", "x", "word", "Ünïcødé ß ñ 漢字 کتاب", "\x00\x1f", "a" * 5000, "!!! ??? 123 ²", "one two", "<|endoftext|> <|im_end|>", "long " * 30_000]


# ---------------------------------------------------------------- language ID


def brute_word(pieces, probs, s):
    if not s:
        return 1.0
    total = sum(probs[k] * brute_word(pieces, probs, s[len(p) :]) for k, p in enumerate(pieces) if s.startswith(p))
    return total + (0 if s[0] in pieces else langid._UNKNOWN * brute_word(pieces, probs, s[1:]))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]
    probs = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 3).T
    words = ["ab", "aba", "b", "xab", "abab" * 3, "ßa", "a"]
    got = langid._Lattice(pieces).forward(words, probs)
    for w, row in zip(words, got):
        assert np.allclose(row, [math.log(brute_word(pieces, probs[:, k], "▁" + w)) for k in range(3)])


def test_expected_counts_are_posterior_averages():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    probs = np.random.default_rng(1).dirichlet(np.ones(len(pieces)))
    word = "aab"

    def all_ways(s):
        if not s:
            yield [], 1.0
        for k, p in enumerate(pieces):
            if s.startswith(p):
                for rest, q in all_ways(s[len(p) :]):
                    yield [k, *rest], probs[k] * q

    ways = list(all_ways("▁" + word))
    z = sum(q for _, q in ways)
    want = [sum(q * w.count(k) for w, q in ways) / z * 2 for k in range(len(pieces))]
    assert np.allclose(langid._Lattice(pieces).expected([word, "b"], np.array([2.0, 0.0]), probs), want)


def test_language_of_held_out_and_odd_texts(spark):
    rng = np.random.default_rng(2)
    de = ["der", "haus", "und", "grün", "bäume", "stehen", "wasser", "jeden", "morgen", "licht", "schön", "nicht"]
    rows = [(k, sentence(rng, 30, de if k % 2 else WORDS), "de" if k % 2 else "en") for k in range(80)]
    rows += [(100 + k, t, "en" if k % 3 else None) for k, t in enumerate(ODD)]
    docs = frame(spark, [*rows, rows[0]])
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    assert model.languages == ["de", "en"]
    got = langid.predict(docs, model, lang_out="guess", score_out="prob").collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert 0 <= r.prob <= 1 and r.score == 9.0
        if r.doc_id < 80:
            assert r.guess == r.lang
        elif not any(c.isalpha() for c in r.text or ""):
            assert (r.guess, r.prob) == ("und", 0.0)
    kept = langid.keep_known_language(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 80").count() == 81 and kept.where("text is null or text = ''").count() == 0


def test_language_of_nothing(spark):
    docs = frame(spark, [(1, "hello", None)])
    model = langid.fit(docs)
    assert [(r.guess, r.prob) for r in langid.predict(docs, model, lang_out="guess", score_out="prob").collect()] == [("und", 0.0)]
    assert langid.predict(docs.where("false"), model, lang_out="guess", score_out="prob").count() == 0


def test_posterior_of_whole_texts(spark):
    """The score is the share of exp(sum of log P(word | language)) among the languages."""
    rng = np.random.default_rng(17)
    de = ["der", "haus", "und", "grün", "wasser", "nicht"]
    docs = frame(spark, [(k, sentence(rng, 3, de if k % 2 else WORDS), "de" if k % 2 else "en") for k in range(30)])
    model = langid.fit(docs)
    asked = ["der house und nicht", "the wasser", "grün green", "haus " * 3 + "the near", "x1y2z the"]
    at = {p: k for k, p in enumerate(model.pieces)}

    def word(s, k):
        if not s:
            return 1.0
        total = sum(model.probs[at[s[:n]], k] * word(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in at)
        return total + (0 if s[0] in at else langid._UNKNOWN * word(s[1:], k))

    for r in langid.predict(frame(spark, [(k, t, None) for k, t in enumerate(asked)]), model, lang_out="guess", score_out="prob").collect():
        log = [sum(math.log(word("▁" + w, k)) for w in langid.words_of(r.text) if model.letters & set(w)) for k in range(2)]
        post = np.exp(np.array(log) - max(log))
        assert r.guess == model.languages[int(np.argmax(log))] and r.prob == pytest.approx(max(post) / post.sum(), rel=1e-9)


def test_unlearnt_scripts_are_no_evidence(spark):
    rng = np.random.default_rng(18)
    de = ["der", "haus", "und", "grün", "bäume", "stehen", "wasser", "jeden"]
    docs = frame(spark, [(k, sentence(rng, 30, de if k % 3 else WORDS), "de" if k % 3 else "en") for k in range(90)])
    model = langid.fit(docs)
    texts = ["Все люди рождаются свободными и равными", "漢字" * 100, "ж" * 64, "ж" * 5000, "ψ" * 64 + " λ" * 70, "q" * 64, "x" * 100_000]
    got = {r.text: r for r in langid.predict(frame(spark, [(k, t, None) for k, t in enumerate(texts)]), model, lang_out="guess", score_out="prob").collect()}
    for t in texts:
        assert got[t].guess in model.languages and math.isfinite(got[t].prob)
        if t[0] not in "qx":
            assert (got[t].guess, got[t].prob) == ("de", pytest.approx(0.5))
    kept = langid.keep_known_language(frame(spark, [(k, t, None) for k, t in enumerate(texts)] + [(9, "the house is red and the trees are green", None)]), model)
    assert {r.doc_id for r in kept.collect()} <= {5, 6, 9} and kept.where("doc_id = 9").count() == 1


def test_no_product_underflows():
    """A run of the least likely letters, under a model of many pieces, stays finite."""
    pieces = langid.vocabulary()
    floor = np.full((len(pieces), 2), 1e-3 / len(pieces))
    words = langid.words_of("ж" * 64 + " " + "z" * 5000 + " 漢" * 3)
    assert np.isfinite(langid._Lattice(pieces).forward(words, floor)).all()


def test_rare_languages_and_dirty_labels(spark):
    """A rare language is learnt from all of its texts; labels beyond the most frequent are not learnt."""
    rng = np.random.default_rng(19)
    it = ["casa", "rossa", "alberi", "acqua", "ogni", "mattina"]
    rows = [(k, sentence(rng, 20), "en") for k in range(400)] + [(1000 + k, sentence(rng, 20, it), "it") for k in range(3)]
    rows += [(2000 + k, "zz", f"label {k}") for k in range(50)]
    model = langid.fit(frame(spark, rows), max_train_docs=20, max_languages=2)
    assert model.languages == ["en", "it"] and model.probs.shape[1] == 2
    got = langid.predict(frame(spark, [(1, sentence(rng, 20, it), None)]), model, lang_out="guess", score_out="prob").first()
    assert got.guess == "it" and got.prob > 0.9


# ---------------------------------------------------------------- quality


def test_quality_learns_junk_and_keeps_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(k, sentence(rng, 40) if k % 3 else " ".join(w.upper() + "!!" for w in rng.choice(WORDS, 40)), "en") for k in range(150)]
    docs = frame(spark, [*rows, *[(200 + k, t, "en") for k, t in enumerate(ODD)]])
    labels = spark.createDataFrame([(k, None if k == 7 else int(k % 3 > 0), 0) for k in range(150)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    got = {r.doc_id: r.q for r in quality.score(docs, model, out="q").collect()}
    assert all((got[k] >= 0.3) == (k % 3 > 0) for k in range(150)) and all(0 <= v <= 1 for v in got.values())
    blank = 1 / (1 + math.exp(-model.bias))
    assert got[200] == got[201] == got[202] == pytest.approx(blank)
    kept = quality.reject_low_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id < 150").collect()} == {k for k in range(150) if k % 3}


def plain_ftrl(rows, bits, alpha=0.3, beta=0.05, l1=0.002, l2=0.01, epochs=3):
    """FTRL-proximal, slot by slot; a missing slot counts as zero."""
    z, n = defaultdict(float), defaultdict(float)

    def w(i):
        if i != "bias" and abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i]) * (z[i] != 0)) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = x | {"bias": 1.0}
            now = {i: w(i) for i in x}
            p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
                n[i] += g * g
    return {i: w(i) for i in [*range(1 << bits), "bias"]}


def test_training_and_scores_against_plain_ftrl(spark):
    rng = np.random.default_rng(20)
    rows = [(k, sentence(rng, int(rng.integers(0, 30)), WORDS if k % 2 else ["Buy", "NOW", "the", "house", "9.99", "now!!"]), "en") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.fit(frame(spark, rows), labels, bits=10)
    order = [r.k for r in labels.select(F.col("doc_id").alias("k")).orderBy(F.xxhash64("k"), "k").collect()]
    texts, words = {k: t for k, t, _ in rows}, quality._Words()

    def vector(text):
        out = defaultdict(float)
        for family in quality.features(text, words, 10):
            for slot in family.tolist():
                out[slot] += 8.0 / len(family)
        return dict(out)

    want = plain_ftrl([(vector(texts[k]), k % 2) for k in order], 10)
    assert model.bias == pytest.approx(want["bias"], rel=1e-4)
    assert np.allclose(model.weights, [want[k] for k in range(1 << 10)], rtol=1e-3, atol=1e-5) and (model.weights == 0).any()
    for r in quality.score(frame(spark, rows), model, out="q").collect():
        assert r.q == pytest.approx(1 / (1 + math.exp(-want["bias"] - sum(want[i] * v for i, v in vector(r.text).items()))), abs=1e-4)


def test_features_are_words_and_their_shapes():
    """Four families: words, shapes, and pairs of both; all pairs of one word twice share a slot."""
    words = quality._Words()
    one, two = quality.features("The the Red red 7 77", words, 18), quality.features("the THE reD", words, 18)
    assert [len(f) for f in one] == [6, 6, 5, 5] and one[0][0] == one[0][1] == two[0][0] == two[0][1] and one[0][2] == two[0][2]
    assert one[2][0] == one[2][2] == two[2][0] and quality._shape("Abc12-x") == "Aa9-a"
    assert one[1][4] == one[1][5] and quality.features(" \n", words, 18) == []


def test_training_is_bounded_by_rows_and_slots(spark):
    """Very long texts, and an id that a third of all rows share."""
    rng = np.random.default_rng(21)
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(k, sentence(rng, 20), "en") for k in range(40)] + [(50, f"{long} {k}", "en") for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(50, 1)], "doc_id long, quality int")
    model = quality.fit(frame(spark, rows), labels, max_train_rows=30, max_train_slots=100_000)
    assert np.isfinite(model.weights).all() and math.isfinite(model.bias)


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a b", None), (2, None, None)])
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.q for r in quality.score(docs, model, out="q").collect()] == [0.5, 0.5]


def test_training_sample_is_bounded(spark):
    from lumiframe.llm.common import bounded_by_hash

    n = bounded_by_hash(spark.range(20_000), "id", 1000, 20_000).count()
    assert 850 < n < 1150


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if x]
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [*ODD, "A B c d", "Ärger ÄRGER x y", "a\x0bb\x0cc d\x1ce\x85f", "x y z " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint_text(text) == brute_fingerprint(text)


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowded", [2, 64])
@pytest.mark.parametrize("kind", ["random", "clustered", "skewed"])
def test_links_connect_what_brute_force_connects(spark, crowded, kind):
    rng = np.random.default_rng(4)
    if kind == "random":
        fps = [int(x) for x in rng.integers(-(2**63), 2**63, 300)]
    else:
        base = [int(x) for x in rng.integers(-(2**63), 2**63, 5)] if kind == "clustered" else [0, 7]
        fps = []
        for k in range(300):
            x = base[k % len(base)] & (2**64 - 1)
            for b in rng.integers(0, 64 if kind == "clustered" else 12, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.append(x - 2**64 if x >> 63 else x)
    fps = sorted(set(fps))
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowded=crowded).collect()
    assert {(r.a, r.b) for r in got} <= {*edges, *[(b, a) for a, b in edges]}
    assert brute_components(fps, [(r.a, r.b) for r in got]) == brute_components(fps, edges)


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_links_at_other_radii(spark, radius):
    rng = np.random.default_rng(24)
    fps = {0, 1, 7}
    for k in range(250):
        x = int(rng.integers(0, 2**63)) * (k % 2)
        for b in rng.integers(0, 64 if k % 2 else 14, rng.integers(0, 7)):
            x ^= 1 << int(b)
        for y in (x, x ^ (0b111 << (k % 50))):
            fps.add(y - 2**64 if y >> 63 else y)
    fps = sorted(fps)
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= radius]
    frame_ = spark.createDataFrame([(x,) for x in fps], "fp long")
    for crowded, block in ((2, 16), (64, 4096)):
        got = simhash.links(frame_, radius=radius, crowded=crowded, block=block).collect()
        assert brute_components(fps, [(r.a, r.b) for r in got]) == brute_components(fps, edges)


def test_plan_keeps_values_uncrowded():
    for n in (10**6, 10**8, 10**9):
        parts = simhash.plan(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4, 2)
        assert all(n / 2 ** len(bits) <= 64 for bits, t in parts if t >= 0)


def test_plan_gives_thresholds_that_sum_to_the_pigeonhole_bound():
    for n in (2, 1000, 10**7, 10**9):
        both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
        both[:8, :8] = n / 2  # eight bits that always agree
        parts = simhash.plan(n, both, 2)
        assert sum(t for _, t in parts) == 2 - len(parts) + 1
        assert sorted(b for bits, _ in parts for b in bits) == list(range(64))
        assert any(set(range(8)) <= set(bits) for bits, _ in parts)


def test_near_duplicates_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, None) for k, t in enumerate(ODD)] + [(50, ODD[9], None), (51, None, None), (None, "x", None), (3, "x", None)]
    rows += [(100 + k, sentence(rng, 30), None) for k in range(30)]
    got = [(r.id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    by_id = {i: c for i, _, c in got if i is not None}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[51] == 0 and by_id[50] == 9 and by_id[3] == 3
    assert simhash.near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)]
    star = [(1000, 1001 + k) for k in range(30)]
    edges = [*chain, *[(b, a) for a, b in star], (7, 7), (500, 500), (None, 3), (20, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if None not in e for x in e}
    assert got == brute_components(nodes, [e for e in edges if None not in e])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_one_of_each_group_of_copies_stays(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(4000)]
    rows, groups, k = [], defaultdict(list), 0
    for g in range(12):
        base = list(rng.choice(words, 150 + 20 * g))
        for c in range(1 if g < 4 else 3 if g < 10 else 60):
            w = list(base)
            if c % 3:
                w[int(rng.integers(len(w)))] = "changed"
            rows.append((k, " ".join(w), "en"))
            groups[g].append(k)
            k += 1
    rows += [(900, None, "en"), (901, "", "en"), (902, "short text", "en"), (903, "short text", "en"), (None, "no id", "en"), (None, "no id", "en")]
    docs = frame(spark, rows)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert left == sorted([min(v) for v in groups.values()] + [900, 902])
    assert kept.where("doc_id is null").count() == 2
    again = simhash.keep_one_of_each(frame(spark, [*rows, rows[0], (0, "zzz other", "en")]))
    assert again.where("doc_id = 0").count() == 1
    assert simhash.keep_one_of_each(docs.where("false")).count() == 0


def test_rows_without_an_id_or_of_one_id_are_deduplicated_by_text(spark):
    import corpus_pipeline

    rng = np.random.default_rng(13)
    a, b, c, d = (" ".join(rng.choice([f"w{k}" for k in range(4000)], 80)) for _ in range(4))
    rows = [(None, a, "en"), (None, a, "en"), (None, a + " more", "en"), (5, b, "en"), (5, c, "en"), (5, b, "en"), (2, b + " end", "en"), (None, b, "en"), (None, d, "en"), (7, None, "en"), (7, "", "en")]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark, rows).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5 and {(2, b + " end"), (5, c), (None, d)} <= set(got)
    assert sum(i is None and t.startswith(a) for i, t in got if t) == 1 and sum(not t for _, t in got) == 1
    assert corpus_pipeline.near_dedup(spark, frame(spark, rows).where("false"), "").count() == 0


def test_similar_texts_are_found_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(4000)]
    texts = {}
    for g in range(60):
        base = list(rng.choice(words, 120))
        other = list(base)
        for at in rng.choice(116, 1 + g % 5, replace=False):
            other[at] = "x" + other[at]
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join(other)
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, [(k, t, None) for k, t in texts.items()])).collect()}
    for g in range(60):
        assert (got[2 * g + 1] == 2 * g) == (jaccard(texts[2 * g], texts[2 * g + 1]) >= 0.8)


@pytest.mark.parametrize("block", [300, 2048])
def test_near_pairs_of_a_shared_template_are_all_found(spark, block):
    """Thousands of texts, 72 % of each one template, so that every sample's bucket is full of strangers."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(5000)]
    template, texts = list(rng.choice(words, 45)), []
    for k in range(2000):
        own = list(rng.choice(words, 16))
        texts.append(" ".join(template + own))
        if k % 10 == 0:
            own[6 + k // 10 % 5] = "changed"
            texts.append(" ".join(template + own))
    texts = [texts[k] for k in rng.permutation(len(texts))]
    place, rows = {}, []
    for t in texts:
        w = t.split()
        rows.append(sorted({place.setdefault(tuple(w[k : k + 5]), len(place)) for k in range(len(w) - 4)}))
    has = np.zeros((len(rows), len(place)), np.float32)
    for k, r in enumerate(rows):
        has[k, r] = 1
    common, size = has @ has.T, has.sum(1)
    near = np.argwhere(np.triu(common >= 0.8 * (size[:, None] + size - common), 1)).tolist()
    assert len(near) >= 200
    want = {k: k for k in range(len(texts))} | brute_components({x for e in near for x in e}, near)
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, [(k, t, None) for k, t in enumerate(texts)]), block=block).collect()}
    assert got == want


# ---------------------------------------------------------------- packing


def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x for x in ODD if x] + [" a", "a<|endoftext|>b", "<|endoftext|>", "a  b", "a \n\n b", "it's we'll", "日本 語　x", "a  b", "﻿x", "é", "👩‍👩‍👧 ok", "x" * 700]
    for text, ids in zip(texts, packing.Tokenize()(texts)):
        assert [*t.encode(text, add_special_tokens=False).ids, 0] == ids.tolist()


def test_ids_of_the_queries_equal_the_plain_call(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from lumiframe.llm import queries
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x for x in ODD if x] + ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext |>", "  <|endoftext|>  x"]
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    assert 50256 in want[len(texts) - 1]
    assert [x.tolist() for x in packing.Tokenize(special=True)(texts)] == list(want.values())
    docs = frame(spark, [(k, x, None) for k, x in enumerate(texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crcs = Counter((k, s, zlib.crc32(np.array(v[s : s + 1024], "<u4").tobytes()), len(v)) for k, v in want.items() for s in range(0, len(v), 1024))
    for got in (queries.op6_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got.collect()) == crcs


def test_shortest_pack_first_uses_each_length_once():
    rng = np.random.default_rng(8)
    for _ in range(20):
        histogram = Counter(int(x) for x in rng.integers(1, 65, 300))
        packs = packing.shortest_pack_first(histogram, 64)
        assert all(sum(p) <= 64 and n > 0 for p, n in packs)
        used = Counter()
        for p, n in packs:
            for x in p:
                used[x] += n
        assert used == histogram
        assert sum(n for _, n in packs) <= 1.1 * sum(k * n for k, n in histogram.items()) / 64 + 1
    assert packing.shortest_pack_first({}, 64) == []


def test_pieces_and_places(spark):
    rng = np.random.default_rng(9)
    rows = [(k, t, None) for k, t in enumerate(ODD)] + [(20 + k, sentence(rng, int(rng.integers(1, 400))), None) for k in range(60)] + [(25, "again", None), (20, "x", None), (20, "x", None)]
    got = packing.pack_documents(frame(spark, rows), capacity=128, with_ids=True).collect()
    encode = packing.Tokenize()
    want = Counter()
    for i, t, _ in rows:
        ids = encode([t])[0]
        for s in range(0, len(ids), 128):
            want[i, s, tuple(ids[s : s + 128].tolist()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(by) == list(range(len(by)))
    assert packing.pack_documents(frame(spark, rows).where("false")).count() == 0


def test_slots_are_met_alike_with_and_without_a_broadcast(spark):
    found = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 64).otherwise(1 + F.col("id") % 64).cast("long").alias("length"), F.col("id").alias("ids_crc32"), F.lit(64).cast("long").alias("doc_tokens"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    one = key(packing.pack(found, capacity=64))
    assert one == key(packing.pack(found, capacity=64, broadcast_rows=0)) and len(one) == 5000
    by = defaultdict(list)  # more rank groups give other places, as good
    for r in packing.pack(found, capacity=64, broadcast_rows=0, rows_per_rank_group=100).collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == 5000 and len(by) == len({r[5] for r in one})
    assert all([o for o, _ in sorted(s)] == [0, *itertools.accumulate(n for _, n in sorted(s))][:-1] for s in by.values())


# ---------------------------------------------------------------- language model


def test_lm_scores_against_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(k, sentence(rng, int(rng.integers(0, 30))) + (" rare%d" % k if k % 4 == 0 else ""), None) for k in range(120)] + [(200 + k, t, None) for k, t in enumerate(ODD[:-1])] + [(None, "the house", None), (5, "the the", None)]
    docs = frame(spark, rows)
    got = lm.score(docs, crc_mod("doc_id", 10) != 0).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode("utf-8").lower().split() + [b""]
    train = [tokens(t) for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for t in train for x in t)
    two = Counter(p for t in train for p in zip([b"", *t], t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        w = tokens(t)
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    seen = [r for r in got if r.id is not None and r.id < 120]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert two[b"the", b"house"] > 0


class PlainModel:
    """Deleted interpolation in plain Python: counts in dictionaries, EM token by token."""

    def __init__(self, texts, held, rounds=8):
        self.w = [self.tokens(t) for t in texts]
        one, two, n, v = self.count([t for t, h in zip(self.w, held) if not h])
        self.weights = {b: [1 / 3] * 3 for b in range(lm.BUCKETS)} | {0: [0, 0.5, 0.5]}
        out = Counter(p for t, h in zip(self.w, held) if h for p in zip([b"", *t], t))
        for _ in range(rounds):
            seen = {b: list(x) for b, x in self.weights.items()}
            for (a, b), times in out.items():
                k = self.bucket(one[a])
                each = [x * p for x, p in zip(self.weights[k], (two[a, b] / max(one[a], 1), one[b] / max(n, 1), 1 / (v + 1)))]
                for c in range(3):
                    seen[k][c] += times * each[c] / sum(each)
            self.weights = {b: [y / sum(x) for y in x] for b, x in seen.items()}
        self.one, self.two, self.n, self.v = self.count(self.w)

    @staticmethod
    def tokens(t):
        return (t or "").encode("utf-8").lower().split() + [b""]

    @staticmethod
    def count(texts):
        one = Counter(x for t in texts for x in t)
        return one, Counter(p for t in texts for p in zip([b"", *t], t)), sum(one.values()), len(one)

    @staticmethod
    def bucket(c):
        return 0 if c == 0 else min(1 + int(math.log2(c)), lm.BUCKETS - 1)

    def p(self, a, b):
        x = self.weights[self.bucket(self.one[a])]
        return x[0] * self.two[a, b] / max(self.one[a], 1) + x[1] * self.one[b] / self.n + x[2] / (self.v + 1)

    def score(self, text):
        t = self.tokens(text)
        return sum(math.log10(self.p(a, b)) for a, b in zip([b"", *t], t))


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "shard_bytes": 150}])
def test_lm_score_is_the_plain_model_and_its_probabilities_sum_to_one(spark, sizes):
    rng = np.random.default_rng(22)
    rows = [(k, sentence(rng, int(rng.integers(0, 25))) + (" rare%d" % k if k % 3 == 0 else ""), None) for k in range(150)]
    docs = frame(spark, rows).withColumn("mine", F.col("doc_id") % 10 != 0)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("held")), F.lit(10)) == 0).alias("h")).collect()}
    own = [(i, t) for i, t, _ in rows if i % 10]
    assert any(held[i] for i, _ in own)
    plain = PlainModel([t for _, t in own], [held[i] for i, _ in own])
    got = {r.id: r.score for r in lm.score(docs, F.col("mine"), **sizes).collect()}
    assert all(got[i] == pytest.approx(plain.score(t), abs=2e-4) for i, t, _ in rows)
    for context in [b"", b"the", b"house", b"rare3", b"never seen"]:
        assert sum(plain.p(context, w) for w in plain.one) + plain.p(context, b"never seen") == pytest.approx(1)
    weights = np.array([[0.6, 0.3, 0.1]] * 3)
    assert lm.mixture(weights, np.array([0.5, 0.5, 0.0]), np.array([0.7, 0.3, 0.0]), 2).sum() == pytest.approx(1)


def test_counts_keep_64_bits():
    for x in ([], [0, 1, 2**32 - 1], [5, 2**32, 2**40 + 3]):
        assert lm._numbers(lm._counts(np.array(x, np.int64))).tolist() == x
    assert lm._numbers(b"").tolist() == []
    h = np.array([0, 1, 2**56 - 1, 2**64 - 1], np.uint64)
    assert (lm._unpack(lm._pack(h)) == h & np.uint64(2**56 - 1)).all()


def test_lm_bytes_are_linear_in_the_input(spark):
    """Twice the texts: about twice the packed n-grams.  Rows are up to blocks times shards, four times as many (see the README)."""
    rng = np.random.default_rng(23)
    sent = []
    for n in (200, 400):
        texts = [sentence(rng, 40, [f"w{k}" for k in range(500)]) for _ in range(n)]
        blocks = [texts[k : k + 50] for k in range(0, n, 50)]
        shards = n // 100
        t = [lm._ask(shards)(pa.table({"text": b, "block": [k] * len(b), "role": [0] * len(b)})) for k, b in enumerate(blocks)]
        rows = sum(x.num_rows for x in t)
        assert rows == len(blocks) * shards
        sent.append(sum(len(y) for x in t for c in ("words", "pairs") for y in x.column(c).to_pylist()))
    assert 1.8 < sent[1] / sent[0] < 2.2


def test_em_finds_the_mixture(spark):
    rng = np.random.default_rng(11)
    p2, p1, u = rng.random(4000) * 0.5, rng.random(4000) * 0.1, 0.001
    mix = 0.7 * p2 + 0.2 * p1 + 0.1 * u
    n = rng.poisson(mix * 2000).astype("<u4")
    row = (np.full(4000, 5, np.uint8).tobytes(), p2.astype("<f4").tobytes(), p1.astype("<f4").tobytes(), n.tobytes())
    w = lm._em(spark.createDataFrame([row], "bucket binary, p2 binary, p1 binary, n binary"), u, 5)
    like = lambda x: float((n * np.log(x[0] * p2 + x[1] * p1 + x[2] * u)).sum())
    assert like(w[5]) > like((1 / 3, 1 / 3, 1 / 3)) and w[5].sum() == pytest.approx(1)


def test_lm_with_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b", None), (2, None, None)])
    assert [(r.n_known, r.train_tokens) for r in lm.score(docs, F.lit(False)).collect()] == [(0, 0)] * 2
    assert lm.score(docs.where("false"), F.lit(True)).count() == 0
