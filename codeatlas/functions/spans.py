"""Where regular expressions match: offsets and neighbourhoods in time linear in the text, in built-in functions.

A text is cut into what matches and the gaps between (one more gap than matches). Offsets are running sums of
the pieces' lengths, and what stands around a match is put together from the few pieces next to it, so that a text of
a hundred thousand matches costs a hundred thousand small steps and is never searched from its start again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _blocks(xs: Column) -> Column:
    """Sums of ``SIDE`` neighbours each."""
    count = F.floor((F.size(xs) + SIDE - 1) / SIDE).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda b: _total(F.slice(xs, b * SIDE + 1, F.lit(SIDE))))


def _running(xs: Column, before: Column) -> Column:
    """For each element what all before it sum to; ``before`` has that sum for each block."""
    return F.transform(xs, lambda _, i: F.get(before, F.floor(i / SIDE).cast("int")) + _total(F.slice(xs, i - i % SIDE + 1, i % SIDE)))


def running_sums(xs: Column) -> Column:
    """Sums of all earlier elements of an integer array: of blocks of blocks first, then of blocks, then of elements."""

    def solve(one, two):
        return let(F.transform(two, lambda _, i: _total(F.slice(two, F.lit(1), i))), lambda third: let(_running(one, third), lambda second: _running(xs, second)))

    return let(_blocks(xs), lambda one: let(_blocks(one), lambda two: solve(one, two)))


def starts(found: Column, gaps: Column) -> Column:
    """Offsets of the matches in code points."""

    def placed(f, g):
        lengths = F.transform(f, lambda x, i: F.length(x) + F.length(F.get(g, i)))
        return let(lengths, lambda p: F.transform(running_sums(p), lambda a, i: a + F.length(F.get(g, i))))

    return let(found, lambda f: let(gaps, lambda g: placed(f, g)))


def _right(text: Column, width: int) -> Column:
    return F.right(text, F.lit(width))


def texts_before(found: Column, gaps: Column, width: int, least: int) -> Column:
    """The last ``width`` characters before each match; a match and its gap have ``least`` characters together at least."""
    near = -(-width // least)
    cut = lambda f, g: F.transform(f, lambda x, i: F.struct(_right(F.get(g, i), width).alias("gap"), _right(x, width).alias("own")))

    def one(t, i):
        first = F.greatest(i - near, F.lit(0))
        earlier = F.transform(F.slice(t, first + 1, i - first), lambda p: F.concat(p["gap"], p["own"]))
        return _right(F.concat(F.array_join(earlier, ""), F.get(t, i)["gap"]), width)

    return let(found, lambda f: let(gaps, lambda g: let(cut(f, g), lambda t: F.transform(t, lambda _, i: one(t, i)))))


def texts_after(found: Column, gaps: Column, width: int, least: int) -> Column:
    """The first ``width`` characters after each match."""
    near = -(-width // least)
    cut = lambda f, g: F.transform(g, lambda x, i: F.struct(F.left(x, F.lit(width)).alias("gap"), F.left(F.coalesce(F.get(f, i), F.lit("")), F.lit(width)).alias("own")))

    def one(h, i):
        later = F.transform(F.slice(h, i + 2, F.lit(near)), lambda p: F.concat(p["gap"], p["own"]))
        return F.left(F.array_join(later, ""), F.lit(width))

    return let(found, lambda f: let(gaps, lambda g: let(cut(f, g), lambda h: F.transform(f, lambda _, i: one(h, i)))))
