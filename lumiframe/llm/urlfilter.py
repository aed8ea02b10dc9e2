"""URL filters as a sort-merge range join.

A host's labels are reversed ("www.example.com" -> "com.example.www.") and the
path follows, so that a rule for a host and its subdomains is one interval of
keys.  URLs and rules are dealt to ranges of keys (bounds from a bounded sample;
a key that very many rows share is cut by a hash of the row's id); a rule goes
to each range that its interval touches.  Every range is sorted and swept once,
with a stack of the rules whose interval is open: they are nested.  Of the rules
on the stack whose path opens the URL's path, the longest wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule but one for the empty host; repeated rows are judged each;
repeated rules count once, and of rules for one host and path ``block`` wins;
null rule fields are empty; empty tables are allowed on either side.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_by_hash


def split_url(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host`` (A-Z lower-cased) and ``path``."""
    rest = F.when(F.contains(url_col, F.lit("://")), F.regexp_replace(url_col, r"(?s)\A.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)})


def _reversed(host: str):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge(
    urls: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    rows_per_range: int = 100_000,
    max_sample: int = 200_000,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for each row of ``urls``; ``rules``: host, path, verdict."""
    spark = urls.sparkSession
    rows = split_url(urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))).select("id", "host", "path", F.xxhash64("id").alias("h"))
    rows = rows.withColumn("key", F.concat(_reversed("host"), F.lit("/"), "path"))
    total = urls.count()
    ranges = max(-(-total // rows_per_range), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = bounded_by_hash(rows, "id", min(max_sample, 50 * ranges), total).select("key", "h").limit(2 * max_sample).collect()  # bounded by max_sample
    sample = sorted((r["key"].encode(), r["h"]) for r in sample)
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    sent = spark.sparkContext.broadcast(bounds)

    fields = [T.StructField("id", urls.schema[id_col].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "path", "key")]]
    schema = T.StructType([*fields, T.StructField("verdict", T.StringType()), T.StructField("range", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(sent.value, (k.encode(), h)) for k, h in zip(b.column("key").to_pylist(), b.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:4]], pa.nulls(b.num_rows, pa.string()), pa.array(at, pa.int32())], names=names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value
        for b in batches:
            take, at = [], []
            for n, key in enumerate(b.column("key").to_pylist()):
                low = key.encode()
                # all keys that start with low: up to, not including, low with its last "." replaced by "/"
                for r in range(bisect_left(bounds, (low,)), bisect_left(bounds, (low[:-1] + b"/",)) + 1):
                    take.append(n)
                    at.append(r)
            got = b.take(pa.array(take, pa.int64())) if take else b.slice(0, 0)
            yield pa.RecordBatch.from_arrays([*[got.column(c) for c in names[:5]], pa.array(at, pa.int32())], names=names)

    own = rules.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict")])
    own = own.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(F.lit(None).cast(urls.schema[id_col].dataType).alias("id"), "host", "path", _reversed("host").alias("key"), "verdict")
    dealt = rows.mapInArrow(deal_urls, schema).unionByName(own.mapInArrow(deal_rules, schema))
    swept = dealt.repartition(ranges, "range").sortWithinPartitions("range", "key", F.col("verdict").isNull())
    out = T.StructType([*fields[:3], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the stack: (host key, host length, {path: (rule, verdict)}, path lengths), each inside the one below
        stack: list[tuple[str, int, dict[str, tuple[str, str]], set[int]]] = []
        now = None
        for b in batches:
            keep, found, verdicts = [], [], []
            columns = [b.column(c).to_pylist() for c in ("range", "key", "host", "path", "verdict")]
            for n, (r, key, host, path, verdict) in enumerate(zip(*columns)):
                if r != now:
                    stack, now = [], r
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, len(host), {}, set()))
                    stack[-1][2][path] = (host + path, verdict)
                    stack[-1][3].add(len(path))
                    continue
                best = (-1, -1, None, default)
                for _, size, paths, lengths in stack:
                    for m in lengths:
                        if m <= len(path) and (hit := paths.get(path[:m])) and (size + m, size) > best[:2]:
                            best = (size + m, size, *hit)
                keep.append(n)
                found.append(best[2])
                verdicts.append(best[3])
            got = b.take(pa.array(keep, pa.int64())) if keep else b.slice(0, 0)
            yield pa.RecordBatch.from_arrays([*[got.column(c) for c in names[:3]], pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=[f.name for f in out.fields])

    return swept.mapInArrow(sweep, out)
