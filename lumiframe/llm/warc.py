"""Not-modified revisits of web archives, resolved against earlier full responses.

A revisit (a 304 answer) takes its body from the latest *strictly earlier* full
response of the same canonical URL.  Its validators must agree with that
response: an entity tag if it sends one (weak comparison), else the
last-modified date.  The response's headers are then updated with those that a
304 may change.

The as-of join runs over distinct (URL, time) points.  A URL with over
``chunk_points`` points is cut at quantiles of its times, and its parts again,
until none has more; a window looks back within a chunk, and the chunks' last
responses are carried on over a second, small window.  So one URL may hold any
share of all records.  Headers are joined by record id at the end; where very
many revisits share one response, adaptive execution splits that join.

Defined cases: a null URL or time, or no earlier response: ``no_response``; no
validator on the revisit: ``no_validator``; different ones: ``mismatch``; of
several responses of one URL and time the largest record id counts; responses
that repeat a record id count once (with the headers that are largest as text),
at each of their URLs and times; null header maps are empty; repeated revisits
are resolved each; empty tables are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

# Headers that a not-modified answer does not update.
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment and closing slashes; the host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*\z", "")
    host = F.regexp_extract(rest, r"\A[^/?]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(tail, r"(?s)\A[^?]*", 0)
    clean = F.regexp_replace(F.regexp_replace(F.lower(host), r"\Awww\.", ""), r":(80|443)\z", "")
    return F.concat(clean, F.regexp_replace(path, r"/+\z", ""), F.substr(tail, F.length(path) + 1))


def _tag(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\A[Ww]/", "")


def _cut(points: DataFrame, most: int) -> DataFrame:
    """``points`` with ``c``, the least time of their chunk: at most ``most`` points of a URL share one."""
    points = points.withColumn("c", F.lit(float("-inf")))
    quantiles = [x / 64 for x in range(1, 64)]
    while True:
        sizes = points.groupBy("k", "c").agg(F.count("*").alias("n"), F.percentile_approx(F.col("t").cast("double"), quantiles, 1000).alias("cuts"))
        over = sizes.where(F.col("n") > most).select("k", "c", "cuts")
        if over.isEmpty():
            return points
        own = F.array_max(F.filter("cuts", lambda x: x <= F.col("t").cast("double")))
        points = materialize(points.join(over, ["k", "c"], "left").select("k", "t", "r", F.coalesce(own, "c").alias("c")), "points")


def resolve_revisits(records: DataFrame, *, chunk_points: int = 20_000) -> DataFrame:
    """``(record_id, url_key, status, response_id, headers)``, a row per revisit.

    ``records``: record_id, type ('response' or 'revisit'), url, time, headers
    (map of lower-case names).  ``headers`` of the result are merged if the status
    is ``resolved``, else null.
    """
    empty = F.create_map().cast("map<string,string>")
    all_ = records.select("record_id", "type", canonical_url(F.col("url")).alias("k"), F.col("time").alias("t"), F.coalesce("headers", empty).alias("h"))
    responses = all_.where("type = 'response' and k is not null and t is not null")
    revisits = all_.where("type = 'revisit'")
    # one point per URL and time; ids only, headers and bodies stay out of the windows
    points = (
        responses.select("k", "t", F.col("record_id").alias("r"))
        .unionByName(revisits.where("k is not null and t is not null").select("k", "t", F.lit(None).cast(records.schema["record_id"].dataType).alias("r")))
        .groupBy("k", "t")
        .agg(F.max("r").alias("r"))
    )
    points = materialize(points, "points")
    chunked = _cut(points, chunk_points).select("k", "t", "r", "c")
    near = chunked.select("k", "t", "c", F.last("r", ignorenulls=True).over(W.partitionBy("k", "c").orderBy("t").rowsBetween(W.unboundedPreceding, -1)).alias("near"))
    lasts = chunked.where("r is not null").groupBy("k", "c").agg(F.max_by("r", "t").alias("last"))
    far = chunked.select("k", "c").distinct().join(lasts, ["k", "c"], "left")
    far = far.select("k", "c", F.last("last", ignorenulls=True).over(W.partitionBy("k").orderBy("c").rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    asof = near.join(far, ["k", "c"]).select("k", "t", F.coalesce("near", "far").alias("response_id")).where("response_id is not null")
    as_text = F.array_join(F.transform(F.array_sort(F.map_entries("h")), lambda e: F.concat_ws("\u0000", e["key"], e["value"])), "\n")
    heads = responses.groupBy(F.col("record_id").alias("response_id")).agg(F.max_by("h", as_text).alias("rh"))
    found = revisits.join(asof, ["k", "t"], "left").join(heads, "response_id", "left")
    sent_tag, sent_date = F.col("h")["etag"], F.col("h")["last-modified"]
    status = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(sent_tag.isNotNull(), F.when(_tag(sent_tag) == _tag(F.col("rh")["etag"]), "resolved").otherwise("mismatch"))
        .when(sent_date.isNotNull(), F.when(F.trim(sent_date) == F.trim(F.col("rh")["last-modified"]), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    updates = F.map_filter("h", lambda k, v: ~k.isin(*NOT_UPDATED))
    merged = F.map_concat(F.map_filter("rh", lambda k, v: ~F.map_contains_key(updates, k)), updates)
    return found.select("record_id", F.col("k").alias("url_key"), status.alias("status"), "response_id", F.when(status == "resolved", merged).alias("headers"))
