"""What the LM's blocks and shards and the classifier's training hold at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lumiframe.llm import common, lm, quality


def test_distinct_is_unique():
    for x in ([], [7], [3, 1, 3, 2, 1, 3], np.random.default_rng(0).integers(0, 50, 1000)):
        x = np.array(x, np.uint64)
        for got, want in zip(lm._distinct(x), np.unique(x, return_index=True, return_inverse=True, return_counts=True), strict=True):
            assert got.tolist() == want.tolist()


def test_packed_rows_leave_few_at_a_time():
    texts = [f"word{k} und{k % 7} other{k % 31}" for k in range(2000)]
    asked = lm._ask(32)(pa.table({"text": texts, "block": [3] * 2000, "role": [0] * 2000}))
    assert asked.num_rows == 32 and max(b.num_rows for b in asked.to_batches()) <= 8
    shard = asked.filter(pa.compute.equal(asked.column("shard"), 5))
    many = pa.concat_tables([shard.set_column(1, "block", pa.array([k], pa.int32())).set_column(2, "role", pa.array([k % 3], pa.int32())) for k in range(30)])
    told = lm._tell(many)
    assert told.num_rows == 31 and max(b.num_rows for b in told.to_batches()) <= 8
    # every n-gram of the shard stands in 10 main and 10 held-out blocks, once each or as often as its block has it
    own = lm._numbers(shard.column("pair_n")[0].as_py())
    assert lm._numbers(told.column("pairs")[0].as_py()).tolist() == (20 * own).tolist()
    assert lm._numbers(told.column("pairs_main")[1].as_py()).tolist() == (10 * own).tolist()


def test_texts_of_a_block_become_objects_few_at_a_time():
    t = pa.table({"text": ["a b"] * 1000})
    sizes = [b.num_rows for b in t.to_batches(max_chunksize=256)]
    assert max(sizes) <= 256 and list(lm._texts(t)) == ["a b"] * 1000


def test_training_reads_small_batches_and_leaves_the_session_alone(spark, monkeypatch):
    key, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    inner = common.arrow_rows

    def recorded(session, rows):
        asked.append(rows)
        return inner(session, rows)

    monkeypatch.setattr(quality, "arrow_rows", recorded)
    docs = spark.createDataFrame([(k, "good text here" if k % 2 else "BAD !!! 999") for k in range(60)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    assert asked and max(asked) <= 256 and spark.conf.get(key) == before
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got[1] > 0.5 > got[0]
