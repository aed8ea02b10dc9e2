"""How sources differ in their words, within each language, with DataFrame operations.

Terms are runs of ASCII letters and of anything beyond ASCII; only A-Z are
lower-cased.  A language keeps the ``V`` terms that at least ``min_docs`` of its
documents hold.  A group (language, source) gives a kept term of ``c`` occurrences,
out of ``N``, the whole number

    p = 1 + floor(scale * (c + a) / (N + a * V))

and two sources differ by the sum over all kept terms of ``|p - q|``.  Most terms are
in neither of two groups, so the sum is put together from what is there:

1. *One-sided terms.*  Were a group's terms in no other group, they would cost
   ``|p - z|`` each, ``z`` being the other group's number for an absent term.  That
   depends on the term's count alone, so it is priced from the group's histogram of
   counts: running sums over the histogram, ordered together with the others' ``z``.
2. *Overlaps.*  A term that both groups hold was priced twice, once for each; a join
   of postings (language, term) replaces this by the true difference.
3. *Both zero.*  The other kept terms cost ``|z - z'|``, a constant times their number
   by inclusion and exclusion.

No group's terms and no term's groups are collected anywhere; no row stands for a
term that a group lacks.  Frequent terms and hot sources are summed before they are
shuffled.  Arithmetic is exact: products are decimals of up to 31 digits, all else
64-bit whole numbers.

Defined cases: null languages, sources and texts are empty strings; repeated rows are
documents of their own; a group without terms has count 0 everywhere; a language
without kept terms has value 0 for each pair; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, repeats included."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN, -1), "")


def share(count: str, total: str, terms: str, smoothing: int, scale: int) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * terms))``, exactly."""
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"1 + ({wide(f'{count} + {smoothing}L')} * cast({scale} as decimal(10, 0))) div {wide(f'{total} + {smoothing}L * {terms}')}")


def _postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, source, c, lang_c, one)``: occurrences in the group and in the language; ``one`` marks a row of each term."""
    split = docs.select("lang", "source", terms_of(F.col("text")).alias("w"))
    # one explode gives both: each occurrence, then each term of the document once
    each = split.select("lang", "source", F.size("w").alias("n"), F.posexplode(F.concat("w", F.array_distinct("w"))).alias("at", "term"))
    counted = each.groupBy("lang", "source", "term").agg(F.sum((F.col("at") < F.col("n")).cast("long")).alias("c"), F.sum((F.col("at") >= F.col("n")).cast("long")).alias("d"))
    of_term = W.partitionBy("lang", "term")
    known = counted.select("lang", "term", "source", "c", F.sum("d").over(of_term).alias("docs"), F.sum("c").over(of_term).alias("lang_c"), (F.min("source").over(of_term) == F.col("source")).alias("one"))
    return known.where(F.col("docs") >= min_docs).drop("docs")


def _differences(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: each two sources of a language, in both orders."""
    g = groups.select("lang", "source", "z", "n_terms", "V")
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("at"), F.col("n_terms").alias("other_terms"))
    asked = g.join(other, "lang").where("source <> item").select("lang", "source", "item", "at", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), ((F.col("V") - F.col("n_terms") - F.col("other_terms")) * F.abs(F.col("z") - F.col("at"))).alias("zeros"))
    none = F.lit(None)
    histogram = priced.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("n"))
    held = histogram.select("lang", "source", none.cast("string").alias("item"), "at", "n", (F.col("n") * F.col("at")).alias("m"), none.cast("long").alias("zeros"))
    whole = W.partitionBy("lang", "source")
    below = whole.orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    runs = held.unionByName(asked).select("lang", "source", "item", "at", "zeros", *[F.sum(x).over(w).alias(f"{x}_{k}") for x in "nm" for k, w in (("below", below), ("whole", whole))])
    one_sided = F.expr("at * (2 * n_below - n_whole) + m_whole - 2 * m_below")
    alone = runs.where("item is not null").select("lang", "source", "item", one_sided.alias("x"), "zeros")
    alone = alone.select("lang", F.explode(F.array(F.struct("source", "item", (F.col("x") + F.col("zeros")).alias("x")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "x"))).alias("s"))
    a, b = (priced.select("lang", "term", F.col("source").alias(f"source_{k}"), F.col("p").alias(f"p_{k}"), F.col("z").alias(f"z_{k}")) for k in "ab")
    put_right = F.expr("abs(p_a - p_b) - abs(p_a - z_b) - abs(z_a - p_b) + abs(z_a - z_b)")
    both = a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(put_right).alias("x"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), "x"), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), "x"))).alias("s"))
    return alone.unionByName(both).groupBy("lang", "s.source", "s.item").agg(F.sum("s.x").alias("value"))


def divergence(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = 30,
    smoothing: int = 5,
    scale: int = 1_000_000_000,
    top_terms: int = 50,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: how far each other source of the language is, all of them.  Part
    ``term``: the ``top_terms`` terms that a source has most in excess of its
    language.  Ranks go by value, largest first, then by item.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    postings = materialize(_postings(texts, min_docs), "postings")
    langs = postings.groupBy("lang").agg(F.sum(F.col("one").cast("long")).alias("V"), F.sum("c").alias("lang_n"))
    sums = postings.groupBy("lang", "source").agg(F.sum("c").alias("N"), F.count("*").alias("n_terms"))
    named = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["N", "n_terms", "V", "lang_n"])
    absent = F.when(F.col("V") > 0, share("0L", "N", "V", smoothing, scale)).otherwise(F.lit(0).cast("long"))
    groups = materialize(named.withColumn("z", absent), "groups")
    priced = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "z", share("c", "N", "V", smoothing, scale).alias("p"), share("lang_c", "lang_n", "V", smoothing, scale).alias("q"),
    )
    priced = materialize(priced, "priced")
    discard(postings)
    ranks = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(ranks).alias("rank"))
    pairs = part(_differences(priced, groups), "pair")
    terms = part(priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term").where(F.col("rank") <= top_terms)
    out = materialize(pairs.unionByName(terms), "divergence")
    discard(groups, priced)
    return out
