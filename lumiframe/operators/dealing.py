"""Dealing rows to tasks by their cost, longest first, over a histogram.

Hashing deals rows evenly, not work: one image may cost as much as ten thousand
others.  Costs go into buckets of relative width 1/32, at most 2,048 of them whatever
the table; the histogram is dealt on the driver as longest-processing-time scheduling
deals jobs, a bucket at a time: its rows fill the tasks that have least up to one
level.  Ranks within a bucket, counted in salted parts, then say which row goes where.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(cost: Column) -> Column:
    """The bucket of a cost: its leading six bits and how many more there are."""
    c = F.greatest(cost.cast("bigint"), F.lit(0).cast("bigint"))
    more = F.greatest(F.length(F.bin(c)) - 6, F.lit(0))
    return (more * 64 + F.call_function("shiftright", c, more)).cast("int")


def fill(loads: np.ndarray, cost: float, n: int) -> np.ndarray:
    """How many of ``n`` jobs of one ``cost`` each task gets, the least loaded first; ``loads`` is added to."""
    quota = np.zeros(len(loads), np.int64)
    if cost > 0:
        order = np.sort(loads)
        # the level that the jobs reach: the largest k tasks that lie below it share them
        k = np.arange(1, len(loads) + 1)
        level = (cost * n + np.cumsum(order)) / k
        upto = np.append(order[1:], np.inf)
        top = level[np.argmax(level <= upto)]
        quota = np.floor(np.maximum(0, top - loads) / cost + 1e-9).astype(np.int64)
        over = int(quota.sum()) - n
        for t in np.flatnonzero(quota)[: max(over, 0)]:  # rounding
            quota[t] -= 1
    loads += quota * cost
    left = n - int(quota.sum())
    while left > 0:
        least = np.argsort(loads, kind="stable")[:left]
        quota[least] += 1
        loads[least] += cost
        left -= len(least)
    return quota


def longest_first(histogram: list[tuple[int, int, int]], tasks: int) -> list[tuple[int, int, int, int]]:
    """``(bucket, rank0, rank1, task)`` of a histogram (bucket, rows, cost of all of them)."""
    loads, out = np.zeros(tasks), []
    for bucket, n, total in sorted(histogram, key=lambda b: -b[2] / b[1]):
        at = 0
        for task, q in enumerate(fill(loads, total / n, n).tolist()):
            if q:
                out.append((bucket, at, at + q, task))
                at += q
    return out


def deal(rows: DataFrame, cost: str, tasks: int, *, key: str = "image_id", rows_per_part: int = 100_000, broadcast_rows: int = 50_000) -> DataFrame:
    """``rows`` in ``tasks`` partitions of about equal sums of ``cost``; ``rows`` is read more than once."""
    spark = rows.sparkSession
    named = rows.withColumn("_bucket", bucket_of(F.coalesce(F.col(cost), F.lit(0))))
    histogram = [tuple(r) for r in named.groupBy("_bucket").agg(F.count("*"), F.sum(F.coalesce(F.col(cost), F.lit(0)).cast("bigint"))).collect()]  # 2,048 rows at most
    ranges = longest_first(histogram, tasks)
    salts = max(1, -(-max((n for _, n, _ in histogram), default=0) // rows_per_part))
    salted = named.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    sizes = salted.groupBy("_bucket", "_salt").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("_bucket", "_salt", "sum(n) over (partition by _bucket order by _salt) - n as _before")
    ranked = salted.selectExpr("*", f"row_number() over (partition by _bucket, _salt order by `{key}`) - 1 as _r").join(before, ["_bucket", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    ends = spark.createDataFrame(ranges, "_bucket int, rank0 long, rank1 long, task int").groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("rank1", "task"))).alias("_ends"))
    if len(ranges) <= broadcast_rows:
        placed = ranked.join(F.broadcast(ends), "_bucket")
    else:  # buckets meet their ranges in as many parts as they were ranked in
        placed = ranked.join(ends.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["_bucket", "_salt"])
    task = F.filter("_ends", lambda e: e["rank1"] > F.col("_rank"))[0]["task"]
    return placed.select(*rows.columns, task.alias("_task")).repartitionById(tasks, F.col("_task")).drop("_task")
