"""The pipeline, stage by stage, on the smallest tables; each stage against a plain version of it."""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumiframe.llm import packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1][1], SF).write.parquet(path)
        out.append((name, spark.read.parquet(path)))
    return out


def rows(stages, k):
    return {r.doc_id: r.text for r in stages[k][1].select("doc_id", "text").collect()}


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "packing"]
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns and df.count() > 50


def test_quality_drops_what_is_labelled_bad(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(stages, 1)
    said = [(q, d in kept) for d, q in labels.items() if d in rows(stages, 0)]
    assert np.mean([bool(q) == k for q, k in said]) > 0.95


def test_languages_stay(stages):
    assert len(rows(stages, 2)) >= 0.98 * len(rows(stages, 1))


def test_one_of_each_group(stages):
    before, after = rows(stages, 2), rows(stages, 3)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in before.items()}
    root = {d: d for d in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(before)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if before[a] == before[b] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {d for d in before if find(d) == d}


def test_no_benchmark_item_is_left(spark, stages):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages, 3), rows(stages, 4)
    holds = {d for d, t in before.items() if any(i in " ".join(words(t)) for i in items)}
    assert holds and not holds & set(after)
    assert len(set(before) - set(after) - holds) <= 0.02 * len(before)


def test_packing_holds_every_id_of_what_is_left(stages):
    texts = rows(stages, 4)
    got = stages[5][1].collect()
    encode = packing.Tokenize()
    want = Counter({d: len(encode([t])[0]) for d, t in texts.items()})
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    fill = sum(have.values()) / (1024 * len({r.sequence_id for r in got}))
    assert fill > 0.95


def tables(spark, path, docs):
    """Documents of odd rows and columns that the operators use themselves, with labels and a benchmark."""
    df = spark.createDataFrame([(*d, 1.0, "x", 2) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score double, sequence_id string, fp long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], None if d[0] is None else int(d[0] % 7 > 0), 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


ITEM = " ".join(f"item{k} of the test" for k in range(12))


def test_all_stages_take_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    text = lambda k: " ".join(w.upper() + "!!" if k % 7 == 0 else w for w in rng.choice(words, 60))
    clean = {k: text(k) for k in range(70)}
    docs = [(k, t, "en", "s", 9) for k, t in clean.items()]
    docs += [(None, None, None, None, None), (71, None, "en", "s", 0), (72, "", "en", "s", 0), (73, "  \n", None, "s", 0), (None, clean[1], None, None, None), (1, clean[1], "en", "s", 9), (74, clean[2] + " more", "en", "s", 9)]
    docs += [(75, clean[3] + " " + ITEM, "en", "s", 9), (76, " ".join(rng.choice(words, 20_000)), "en", "s", 9), (3, text(1), "en", "other row of this id", 9)]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, docs)).collect()
    kept = {r.doc_id for r in got}
    assert None not in kept and {1, 2, 3, 4, 5, 6, 76} <= kept and not kept & {71, 72, 73, 74, 75} and not kept & {7, 14, 21}
    assert len({r.doc_tokens for r in got if r.doc_id == 3}) >= 1 and len([r for r in got if r.doc_id == 3]) == 2
    assert len([r for r in got if r.doc_id == 1]) == 1 and len([r for r in got if r.doc_id == 76]) > 10


def test_all_stages_take_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5][1].columns
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(stages[5][1])
