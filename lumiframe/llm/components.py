"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation (min of the neighbours, combined before the
shuffle) and one join, so a hub with a third of all edges is only a skewed join,
which adaptive execution splits.  Nothing is collected; each round's edges are
written to the shared folder, and deleted when the next round's are there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that edges a-b reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b, of one ordered type).

    ``root`` is the smallest node that can be reached.  Loops and repeated edges
    are allowed; an empty table gives an empty result; null ends are left out.
    """
    edges = materialize(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now, written, before = edges.where("a <> b").distinct(), None, None
    for _ in range(max_rounds):
        last, now = written, materialize(_small_star(_large_star(now).distinct()).distinct(), "star")
        written = now
        discard(last)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a node may appear in several edges only until the star is reached; min() is then exact
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return members.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
