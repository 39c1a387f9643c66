"""Places of regular-expression matches, in SQL functions only.

Folds over arrays copy what they have gathered at each step, and characters of a string are found by walking it; so both are done in
blocks, which keeps texts with very many matches from taking quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Items of a block.
BLOCK = 128


def no_spans() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """The items in arrays of BLOCK; none for none."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) + BLOCK - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def _placed(steps: Column) -> Column:
    """Spans of an array of (gap, value), gap being the characters since the match before."""

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("spans"))
    inside = F.transform(blocks(steps), lambda block: F.aggregate(block, start, step))

    def onward(done: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        begins = F.aggregate(done, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.flatten(F.zip_with(done, begins, lambda d, s: F.transform(d["spans"], lambda x: F.struct((x["start"] + s).alias("start"), (x["end"] + s).alias("end"), x["value"].alias("value")))))

    return bound(inside, onward)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of (start, end, value) of all leftmost non-overlapping matches; code points, end exclusive.

    The texts between the matches, from split(), give the places: both walk the same matches.  The pattern must not match
    nothing.  A null text gives null.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = bound(found, lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), 1, F.size(m)), lambda v, gap: F.struct(F.length(gap).cast("bigint").alias("gap"), v.alias("value"))))
    return bound(steps, _placed)


def masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted by start) replaced by ``mask(span)``; a span that begins inside a replaced one is taken with it."""

    def replaced(acc: Column, block: Column) -> Column:
        """Goes on from acc: at (how far the text is written), out (texts of blocks)."""
        whole = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), F.array_max(F.transform(block, lambda x: x["end"])) - acc["at"]).cast("int"))

        def within(segment: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))

            def step(now: Column, x: Column) -> Column:
                piece = F.array(F.substring(segment, (now["at"] - acc["at"] + 1).cast("int"), (x["start"] - now["at"]).cast("int")), mask(x))
                fresh = F.struct(x["end"].alias("at"), F.concat(now["out"], piece).alias("out"))
                return F.when(x["start"] >= now["at"], fresh).otherwise(F.struct(F.greatest(now["at"], x["end"]).alias("at"), now["out"].alias("out")))

            return F.aggregate(block, start, step)

        done = bound(whole, within)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    def all_blocks(spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.filter(blocks(spans), lambda b: F.size(b) > 0), start, replaced, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))

    return bound(spans, lambda s: F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, text).otherwise(all_blocks(s)))
