"""Positions of regular-expression matches as array columns, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,hit:string>>"


def scanned(values: Column, merge: Callable[[Column, Column], Column], kind: str, back: bool = False) -> Column:
    """Of each place in an array, what ``merge(later, earlier)`` makes of all values up to it (``back``: from it on).

    ``merge`` must be associative and give the array's element type ``kind``. Work is n log n: passes reach 1, 2,
    4 ... places, as many as the array's size asks for.
    """

    def over(v: Column) -> Column:
        passes = F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")

        def once(acc: Column, k: Column) -> Column:
            reach = F.call_function("shiftleft", F.lit(1), k)
            step = lambda x, i: F.when((i + reach < F.size(acc)) if back else (i >= reach), merge(x, F.get(acc, (i + reach) if back else (i - reach)))).otherwise(x)
            return F.transform(acc, step).cast(f"array<{kind}>")

        return F.when(passes > 0, F.aggregate(F.sequence(F.lit(0), passes - 1), v, once)).otherwise(v)

    return within(values.cast(f"array<{kind}>"), over)


def match_spans(text: Column, pattern: Column, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string: start, end and matched text.

    Positions are sums of ``measure`` over what comes before; the default counts code points. The text is split
    at the matches only where there are any.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct((measure(gap) + measure(hit)).cast("int").alias("end"), measure(hit).cast("int").alias("own"), hit.alias("hit")))
    ends = scanned(steps, lambda x, y: F.struct((x["end"] + y["end"]).alias("end"), x["own"].alias("own"), x["hit"].alias("hit")), "struct<end:int,own:int,hit:string>")
    spans = F.transform(ends, lambda s: F.struct((s["end"] - s["own"]).alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))
    return F.when(F.size(hits) > 0, spans.cast(EMPTY)).otherwise(F.array().cast(EMPTY))


def within(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
