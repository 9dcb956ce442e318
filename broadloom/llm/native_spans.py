"""Match positions with built-in functions only.

Spark has no function for the positions of all matches. Splitting a text at a pattern gives
what lies between its matches, extracting gives the matches; running sums of both lengths
give code-point positions. Only texts with a match are split. Time and memory are n log n
for n matches: sums double their reach in each round, and overlaps are found by bisection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string,part:string,before:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative ``join``: in round k every place takes
    in what lies 2^k before it."""

    def wider(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= step, join(F.get(acc, i - step), x)).otherwise(x))

    def totals(v: Column) -> Column:
        rounds = F.ceil(F.log2(F.size(v).cast("double"))).cast("int")
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), v, wider))

    return bind(values, totals)


def find_spans(text: Column, pattern: str, part: int = 0, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern (Java syntax): start, end (code points,
    end exclusive), text, the group ``part``, and up to ``context`` characters before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else found
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"), parts.alias("parts"))

    def placed(s: Column) -> Column:
        lengths = F.transform(s["found"], lambda m, i: F.length(F.get(s["gaps"], i)) + F.length(m))
        return bind(running(lengths, lambda a, b: a + b), lambda ends: F.transform(s["found"], lambda m, i: span(s, ends, m, i)))

    def span(s: Column, ends: Column, match: Column, i: Column) -> Column:
        end = F.get(ends, i)
        before = F.substring(F.get(s["gaps"], i), -context, context) if context else F.lit("")
        own = F.get(s["parts"], i) if part else match
        return F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("text"), own.alias("part"), before.alias("before"))

    return F.when(text.rlike(pattern), bind(cut, placed)).otherwise(no_spans())


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``: of the base spans that start before a span's
    end (their number by bisection), the furthest must end by its start."""
    ordered = F.sort_array(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))

    def free(b: Column) -> Column:
        reach = running(F.transform(b, lambda x: x["end"]), F.greatest)
        return bind(F.struct(F.transform(b, lambda x: x["start"]).alias("start"), reach.alias("reach")), lambda t: F.filter(spans, lambda x: clear(t, x)))

    def clear(t: Column, x: Column) -> Column:
        def nearer(at: Column, k: Column) -> Column:
            further = at + F.call_function("shiftleft", F.lit(1), k)
            return F.when(F.get(t["start"], further - 1) < x["end"], further).otherwise(at)

        top = F.ceil(F.log2(F.size(t["start"]).cast("double"))).cast("int")
        before = F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), nearer)
        return bind(before, lambda n: F.coalesce(F.get(t["reach"], n - 1) <= x["start"], F.lit(True)))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(bind(ordered, free))


def named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))
