"""Running sums of long sequences in two levels.

A window over a whole image puts it in one task, however long it is.  Here sequences
are cut into chunks of ``CHUNK`` places: windows run within chunks, the chunks' totals
(one row each) are summed by a second, small window, and come back to their chunks as
carries by a join on the key that the first window was dealt by, so the long side is
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr

CHUNK = 1 << 16


def with_chunk(rows: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    """``rows`` with ``chunk``, the part of the sequence that the place ``order`` lies in."""
    return rows.withColumn("chunk", expr.idiv(F.col(order).cast("bigint"), size))


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], *, inclusive: bool = False, size: int = CHUNK) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over the places before (``inclusive``: and this one).

    ``order`` are whole numbers from 0 on, each once a key.  Columns of the names of
    ``sums`` and ``chunk`` are replaced.
    """
    cut = with_chunk(rows, order, size)
    inside = W.partitionBy(*keys, "chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = cut.groupBy(*keys, "chunk").agg(*[F.sum(c.cast("bigint")).alias(f"_total_{n}") for n, c in sums.items()])
    carries = totals.select(*keys, "chunk", *[F.coalesce(F.sum(f"_total_{n}").over(before), zero).alias(f"_carry_{n}") for n in sums])
    local = cut.select("*", *[F.coalesce(F.sum(c.cast("bigint")).over(inside), zero).alias(f"_local_{n}") for n, c in sums.items()])
    both = local.join(carries, [*keys, "chunk"])
    return both.select(*[c for c in rows.columns if c not in sums and c != "chunk"], *[(F.col(f"_local_{n}") + F.col(f"_carry_{n}")).alias(n) for n in sums])
