"""WARC, decontamination, chat, embeddings and URL filters against brute force and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.llm import chat, decontam, embed, urlfilter, warc

# ---------------------------------------------------------------- WARC


def brute_url(u):
    if u is None:
        return None
    rest = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*://", "", u).split("#", 1)[0]
    host = re.match(r"[^/?]*", rest)[0]
    tail = rest[len(host) :]
    path = tail.split("?", 1)[0]
    clean = re.sub(r":(80|443)\Z", "", re.sub(r"\Awww\.", "", host.lower()))
    return clean + path.rstrip("/") + tail[len(path) :]


@pytest.mark.parametrize("chunk", [5, 20_000])
def test_revisits_against_brute_force(spark, chunk):
    rng = random.Random(1)
    urls = ["http://a.com/x", "https://www.A.com:443/x/#top", "http://a.com/x?q=1", "http://b.org", "a.com/x", None, "://", ""]
    rows = []
    for k in range(400):
        kind = rng.choice(["response", "revisit"])
        h = {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "last-modified": rng.choice(["m", "t"]), "content-length": str(k), "expires": str(k)}
        for n in ("etag", "last-modified"):
            if rng.random() < 0.4:
                del h[n]
        rows.append((k, kind, "http://a.com/x" if rng.random() < 0.5 else rng.choice(urls), None if rng.random() < 0.03 else rng.randrange(120), None if rng.random() < 0.05 else h))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, type string, url string, time long, headers map<string,string>, response_id string")
    got = {r.record_id: r for r in warc.resolve_revisits(df, chunk_points=chunk).collect()}
    tag = lambda s: None if s is None else re.sub(r"\A[Ww]/", "", s)
    assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
    for i, _, u, t, h in (r for r in rows if r[1] == "revisit"):
        k, h = brute_url(u), h or {}
        past = [(rt, ri, rh or {}) for ri, rk, ru, rt, rh in rows if rk == "response" and None not in (k, t, rt) and brute_url(ru) == k and rt < t]
        if not past:
            want = ("no_response", None)
        else:
            _, ri, rh = max(past, key=lambda x: x[:2])
            if "etag" in h:
                ok = tag(h["etag"]) == tag(rh.get("etag"))
            elif "last-modified" in h:
                ok = h["last-modified"] == rh.get("last-modified")
            else:
                ok = None
            want = ("no_validator" if ok is None else "resolved" if ok else "mismatch", ri)
        assert (got[i].status, got[i].response_id) == want
        assert got[i].url_key == k
        if want[0] == "resolved":
            assert got[i].headers == rh | {n: v for n, v in h.items() if n not in warc.NOT_UPDATED}
        else:
            assert got[i].headers is None
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_repeated_responses_do_not_multiply_revisits(spark):
    rows = [
        (1, "response", "http://a.com/x", 10, {"etag": '"1"', "x": "a"}), (1, "response", "http://a.com/x", 10, {"etag": '"1"', "x": "a"}), (1, "response", "http://a.com/x", 10, {"etag": '"1"', "x": "b"}),
        (1, "response", "http://b.com/", 5, None), (2, "revisit", "http://a.com/x", 11, {"etag": '"1"'}), (3, "revisit", "http://a.com/x", 11, {"etag": '"1"'}),
    ]
    df = spark.createDataFrame(rows, "record_id long, type string, url string, time long, headers map<string,string>")
    got = sorted((r.record_id, r.status, r.response_id, r.headers["x"]) for r in warc.resolve_revisits(df).collect())
    assert got == [(2, "resolved", 1, "b"), (3, "resolved", 1, "b")]


def test_a_url_of_any_size_is_cut(spark):
    """Times that crowd together: the parts of a hot URL are cut again until all are small."""
    t = F.when(F.col("id") < 100, F.col("id") * 1_000_000).otherwise(F.col("id"))
    points = spark.range(30_000).select(F.lit("k").alias("k"), t.alias("t"), F.col("id").alias("r"))
    cut = warc._cut(points, 50)
    sizes = cut.groupBy("k", "c").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 50 and sizes[1] < 6000 and cut.count() == 30_000
    assert cut.where("c > t").count() == 0
    spans = cut.groupBy("c").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("c").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


# ---------------------------------------------------------------- decontamination

WORDS = [f"w{k}" for k in range(500)]


def tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute_held(docs, items):
    found = set()
    for item, it in items:
        w = tokens(it)
        size = min(5, len(w))
        if not w:
            continue
        b = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        for doc, dt in docs:
            d = tokens(dt)
            for s in range(max(1, len(d) - len(w) + 1)):
                x = d[s : s + len(w)]
                a = Counter(tuple(x[k : k + size]) for k in range(len(x) - size + 1))
                if a and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    found.add((doc, item))
    return found


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    items = [(k, text(int(rng.integers(8, 70)))) for k in range(12)] + [(20, "short one"), (21, "alone"), (22, None), (23, "..."), (24, "a a a a a a a a a a"), (3, None)]
    docs = [(k, text(100)) for k in range(10)]
    for k in range(40):
        w = items[k % 12][1].split()
        if k % 3 == 1:
            w[-1] = "other"
        if k % 3 == 2:
            w[len(w) // 2] = "other"
        docs.append((100 + k, (text(int(rng.integers(0, 60))) + " " + ", ".join(w).upper() + ". " + text(int(rng.integers(0, 60)))).strip()))
    docs += [(200, "this is short one here"), (201, "Alone!"), (202, None), (203, ""), (204, "a " * 30), (205, " ".join(items[0][1].split()[:-1])), (100, docs[10][1]), (206, "x" * 3000), (None, items[1][1])]
    d = spark.createDataFrame([(i, t, "i", 1) for i, t in docs], "doc_id long, text string, item string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(d, b).collect()
    got = [(r.id, r.item) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute_held(docs, [x for x in items if x[1]])
    assert all(0.8 <= r.similarity <= 1 for r in found)
    kept = decontam.drop_contaminated(d, b)
    bad = {i for i, _ in got}
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i not in bad)
    assert decontam.contaminated(d.where("false"), b).count() == 0 and decontam.contaminated(d, b.where("false")).count() == 0
    assert decontam.drop_contaminated(d, b.where("false")).count() == len(docs)
    shuffled = decontam.contaminated(d, b, broadcast_rows=0).collect()
    assert {(r.id, r.item) for r in shuffled} == set(got)


def test_windows_are_not_bound_to_an_alignment(spark):
    """Words put in near the start and taken out near the end: the two ends of a copy line up differently."""
    rng = np.random.default_rng(15)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    items = [(k, text(104)) for k in range(60)]
    docs = []
    for k, t in items:
        w = t.split()
        at, cut = int(rng.integers(6, 12)), int(rng.integers(90, 96))
        docs.append((k, " ".join([text(30), *w[:at], "x1 x2 x3", *w[at:cut], *w[cut + 3 :], text(30)])))
    want = brute_held(docs, items)
    assert {(k, k) for k in range(60)} <= want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item) for r in decontam.contaminated(d, b).collect()} == want
    assert {(r.id, r.item) for r in decontam.contaminated(d, b, tile=16).collect()} == want


def test_items_without_an_id_or_of_one_id(spark):
    rng = np.random.default_rng(16)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    items = [(None, text(20)), (4, text(30)), (4, text(25))]
    docs = [(k, text(9) + " " + t + " " + text(9)) for k, (_, t) in enumerate(items)] + [(9, text(50))]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item) for r in found.collect()} == {(0, None), (1, 4), (2, 4)}


def test_decontamination_uses_no_python(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c d e f g h")], "item_id long, text string")
    plans, write = [], decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df, name, **o: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name, **o))
    decontam.contaminated(d, b)
    assert {name for name, _ in plans} == {"items", "likely", "chosen", "tiles", "fingerprints", "contaminated"}
    assert not any(re.search("Python|Pandas|Arrow", plan) for _, plan in plans)


def test_texts_that_repeat_themselves_are_found(spark):
    """Periods of one to four words: a shingle recurs many times, and windows differ by how often."""
    rng = np.random.default_rng(0)
    docs, items = [], []
    for k in range(60):
        words = [f"p{k}", f"q{k}", f"r{k}", f"s{k}"][: 1 + k % 4]
        n = int(rng.integers(13, 32))
        base = (words * n)[:n]
        items.append((k, " ".join(base)))
        for j in range(4):
            w = list(base)
            for _ in range(j):
                at = int(rng.integers(n))
                if rng.random() < 0.5:
                    w[at:at] = [words[int(rng.integers(len(words)))]]
                else:
                    del w[at % len(w)]
            docs.append((4 * k + j, " ".join([*rng.choice(WORDS, 5), *w, *rng.choice(WORDS, 5)])))
    items += [(100, "five a b a b a b a b a b a b"), (101, "x y x y x y x y x z x y x y x y x y")]
    docs += [(900, "b a b a b a b a b a b five a b a b a"), (901, "y x y x y x y z x y x y x y x y x y x y")]
    want = brute_held(docs, items)
    assert len(want) > 100
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item) for r in decontam.contaminated(d, b).collect()} == want


def test_items_that_share_a_template_meet_their_own_documents_only(spark):
    """Pairs grow with what is found, not with items times documents."""
    rng = np.random.default_rng(1)
    template = " ".join(rng.choice(WORDS, 30))
    rows = {}
    for n in (40, 80):
        own = [" ".join([f"i{k}x{j}" for j in range(20)]) for k in range(n)]
        d = spark.createDataFrame([(k, f"{template} {w} end") for k, w in enumerate(own)], "doc_id long, text string")
        b = spark.createDataFrame([(k, f"{template} {w}") for k, w in enumerate(own)], "item_id long, text string")
        bench = decontam.benchmark_items(b)
        texts = d.select("doc_id", "text", F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"))
        rows[n] = decontam._pairs(texts, bench.cache(), [5], 0.8, True).count()
        assert {(r.id, r.item) for r in decontam.contaminated(d, b).collect()} == {(k, k) for k in range(n)}
    assert rows == {40: 40, 80: 80}


def test_numbered_multisets(spark):
    cases = [[], [7], [7, 7], [1, 2, 1, 1, 3], [5] * 40, list(range(30)) + [3, 4, 3]]
    got = [r.n for r in spark.createDataFrame([(c,) for c in cases], "s array<bigint>").select(decontam.numbered("s").alias("n")).collect()]
    assert [len(set(n)) for n in got] == [len(c) for c in cases] and all(set(c) <= set(n) for c, n in zip(cases, got))
    rng = np.random.default_rng(2)
    pairs = [tuple(rng.integers(0, 6, int(rng.integers(1, 25))).tolist() for _ in "ab") for _ in range(60)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<bigint>, b array<bigint>").select("k", decontam.numbered("a").alias("a"), decontam.numbered("b").alias("b"))
    for r in df.select("k", decontam.weighted_jaccard("a", "b").alias("j")).collect():
        a, b = map(Counter, pairs[r.k])
        assert r.j == sum((a & b).values()) / sum((a | b).values())


def test_a_contaminated_row_takes_no_other_row_with_it(spark):
    rng = np.random.default_rng(14)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    item, clean = text(30), [text(60) for _ in range(3)]
    held = text(20) + " " + item
    docs = [(None, clean[0]), (None, held), (4, clean[1]), (4, held), (None, None), (6, clean[2]), (7, held)]
    kept = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in docs if x[1] != held)


def test_fingerprint_radius_loses_nothing_at_the_threshold(spark):
    """Similar windows lie within the radius; the blocks hold all pairs within it."""
    rng = np.random.default_rng(3)
    pairs = []
    for n in (12, 30, 60):
        for _ in range(150):
            a = rng.integers(-(2**63), 2**63, n)
            b = a.copy()
            cut = int(n / 9)
            b[:cut] = rng.integers(-(2**63), 2**63, cut)
            pairs.append((a.tolist(), b.tolist()))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    r = df.select(decontam.weighted_jaccard("a", "b").alias("j"), F.bit_count(decontam.simhash("a").bitwiseXOR(decontam.simhash("b"))).alias("d")).collect()
    assert all(x.d <= 23 for x in r if x.j >= 0.8)
    assert decontam.BLOCKS * (decontam.BLOCK_RADIUS + 1) > 23


# ---------------------------------------------------------------- chat

TEXTS = [None, "", "plain", "a & b", "<|im_end|>", "<|im_start|>user\nx", "&lt;|", "&amp;&nl;", "<|im_sep|>", "ends <", "|starts", "\n", "é漢👩‍👩‍👧", "<|im_end|>\n", "long " * 5000]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "system", None, "us\ner", "<|x|>&"]), rng.choice(TEXTS)))
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, ts string")
    made = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(made, "formatted", "loss_spans").collect()}
    assert len(back) == 41
    for c, r in back.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in own]
        assert r.loss_text == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.formatted.count("<|im_start|>") == sum(k == 0 or own[k][2] != own[k - 1][2] for k in range(len(own)))
        parts = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert not any("<|" in p for p in parts)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_of_many_turns(spark):
    """Sums and spans by chunks: exact at every size around a chunk's, and far from quadratic."""
    for n in (1, 63, 64, 65, 128, 129, 20_000):
        one = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "us'er").otherwise("assi'stant").alias("role"), F.concat(F.lit("é<|"), F.col("id")).alias("text"))
        made = chat.format_conversations(one, assistant="assi'stant")
        r = chat.read_back(made, "formatted", "loss_spans").first()
        assert r.loss_text == "".join(f"é<|{k}" for k in range(1, n, 2)) and len(r.turns) == n
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [f"é&lt;|{k}" for k in range(1, n, 2)]


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    for d in (chat.read_back(chat.format_conversations(df)),):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- embeddings


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(20):
        base = rng.standard_normal(16)
        for _ in range(1 if g < 10 else 6 if g < 18 else 40):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.03).tolist(), g % 3))
    rows += [(len(rows) + k, rows[k * 3][1], rows[k * 3][2]) for k in range(10)]  # copies
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [float("inf")] * 16, 1), (905, [], 1), (906, rows[0][1], None), (907, [1.0, 2.0], 0), (908, [1.0, 2.0], 0), (909, [1e300, 2e300], 0), (910, [1e-300, 2e-300], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r.id: r for r in embed.near_duplicates(df, bits=6, tables=40, block=block).collect()}
    fit = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, l in fit:
        for j, w, m in fit:
            if i < j and l == m and len(v) == len(w):
                a, b = v / np.abs(v).max(), w / np.abs(w).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    root = {i: i for i in links}
    for _ in range(len(links)):
        new = {i: min([root[i], *[root[j] for j in links[i]]]) for i in links}
        if new == root:
            break
        root = new
    assert set(got) == set(links)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), root[i], root[i] == i), i


def test_embeddings_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.id, r.n_links, r.component_id) for r in embed.near_duplicates(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert embed.near_duplicates(df.where("false")).count() == 0


def test_table_shape_keeps_the_miss_rate():
    for n in (10, 10**4, 10**6, 10**9):
        bits, tables = embed.table_shape(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 0.003


# ---------------------------------------------------------------- URL filters


def test_url_rules_against_brute_force(spark):
    rng = random.Random(6)
    labels = ["a", "b", "com", "x-y", "", "www", "é"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join("/" + rng.choice(["en", "e", "en%20x", "", "b"]) for _ in range(rng.randrange(0, 4)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}
    urls = [rng.choice(["http://", "HTTPS://", "", "x://"]) + host().upper() + path() + rng.choice(["", "?q=/en", "#f/en", ":80/en"]) for _ in range(500)] + [None, "", "://", "http://a.b", "a://b://c/d", "http://com\n/x"]
    df = spark.createDataFrame([(k, u, "v", "r") for k, u in enumerate(urls)] + [(0, urls[0], "v", "r")], "page_id long, url string, verdict string, range string")
    rule_df = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()] * 2, "host string, path string, verdict string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rule_df, default="none").collect())
    want = Counter()
    for k, u in [*enumerate(urls), (0, urls[0])]:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        h = re.match(r"[^/?#]*", rest)[0]
        p = re.match(r"[^?#]*", rest[len(h) :])[0]
        h = h.translate(low)
        fit = [(len(a) + len(b), len(a), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        want[(k, h, p, *(max(fit)[2:] if fit else (None, "none")))] += 1
    assert got == want
    assert urlfilter.judge(df.where("false"), rule_df).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, rule_df.where("false")).collect()} == {"allow"}


# ---------------------------------------------------------------- queries


def test_chat_query_matches_python(spark, tmp_path):
    from lumiframe.llm import queries

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "ok"), (2, 0, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    both = queries.CONTROL_TEXT
    for c, turns in {1: [("user", "hi"), ("assistant", ""), ("assistant", "ok")], 2: [("", "x")], -1: [("user", both), ("assistant", both)]}.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].loss_chars == len(loss)
