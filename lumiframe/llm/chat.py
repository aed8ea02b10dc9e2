"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and joined to one text.
Adjacent turns of one role share a block:

    <|im_start|>role \\n text [<|im_sep|> text ...] <|im_end|> \\n

Control strings can occur only as marks: inside roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also a line feed ``&nl;``),
which :func:`read_back` undoes.  The loss mask is a list of spans (start,
length in code points) of the formatted text: each assistant text by itself,
without marks.

Defined cases: a null text or role is empty; turns sort by (turn, role, text),
nulls first; repeated rows are turns of their own; a null conv_id is a
conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
CHUNK = 64


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


def _chunks(array: Column) -> Column:
    """An array cut into arrays of ``CHUNK``."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(array) - 1) / CHUNK).cast("int"))
    return F.transform(starts, lambda k: F.slice(array, k * CHUNK + 1, F.lit(CHUNK)))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` as a lambda variable: it is made once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, v: s + v)


def running_sums(numbers: Column) -> Column:
    """Of an array of longs: the sum of all before each, by chunks, so that no step copies the whole array."""
    parts = lambda x: F.transform(_chunks(x), lambda c: F.struct(c.alias("own"), _total(c).alias("sum")))
    placed = lambda p: F.transform(p, lambda c, k: F.struct(c["own"].alias("own"), _total(F.transform(F.slice(p, F.lit(1), k), lambda b: b["sum"])).alias("before")))
    each = lambda c: F.transform(c["own"], lambda v, j: c["before"] + _total(F.slice(c["own"], F.lit(1), j)))
    return F.flatten(F.transform(_bind(_bind(numbers, parts), placed), each))


def format_conversations(turns: DataFrame, *, assistant: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from ``turns`` (conv_id, turn, role, text)."""
    one = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    ordered = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # each turn says whether it opens and closes a block; then what stands before and after its text
    edges = F.transform(
        "ts",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            escape(t["text"]).alias("body"),
            F.when((i == 0) | (F.get("ts", i - 1)["role"] != t["role"]), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP)).alias("before"),
            F.when(F.coalesce(F.get("ts", i + 1)["role"] != t["role"], F.lit(True)), F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
        ),
    )
    marked = ordered.select("conv_id", edges.alias("p"))
    # start of each text: what stands before it, added up
    sizes = F.transform("p", lambda x: (F.length(x["before"]) + F.length(x["body"]) + F.length(x["after"])).cast("long"))
    measured = marked.select("conv_id", "p", running_sums(sizes).alias("at"))
    every = F.zip_with("p", "at", lambda x, at: F.struct(x["role"].alias("role"), (at + F.length(x["before"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
    spans = F.transform(F.filter(every, lambda x: x["role"] == F.lit(assistant)), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["body"], x["after"])), "")
    return measured.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, *keep: str) -> DataFrame:
    """``(conv_id, turns, loss_text)`` and the columns ``keep``: what the formatted text and its mask alone say."""
    blocks = F.expr(f"slice(split(formatted, '\\\\Q{START}\\\\E', -1), 2, greatest(0, size(split(formatted, '\\\\Q{START}\\\\E', -1)) - 1))")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(F.regexp_replace(b, r"\A[^\n]*\n", ""), r"\Q" + END + r"\E\n\z", ""), r"\Q" + SEP + r"\E", -1),
                lambda t: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    # pieces of the text that hold CHUNK spans each, and the spans within them: no span is looked for in the whole text
    last = lambda c: F.element_at(c, -1)
    pieces = F.transform(
        F.filter(_bind(F.col("loss_spans"), _chunks), lambda c: F.size(c) > 0),
        lambda c: F.struct(c.alias("spans"), F.get(c, F.lit(0))["start"].alias("from"), F.substr("formatted", F.get(c, F.lit(0))["start"] + 1, last(c)["start"] + last(c)["length"] - F.get(c, F.lit(0))["start"]).alias("text")),
    )
    each = lambda p: F.transform(p["spans"], lambda s: unescape(F.substr(p["text"], s["start"] - p["from"] + 1, s["length"])))
    loss = F.array_join(F.flatten(F.transform(pieces, each)), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), *keep)
