"""Functions on arrays that Spark has no built-in for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.batteries import unbounded


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Within the functions that
    Spark's array functions take, an expression from outside is computed for each entry; a bound one isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """Running fold of an array: entry i is ``step`` over ``start`` and the
    values up to i. Spark's functions on arrays can only build such a result by
    copying it for each entry; here that happens within parts of 256 entries,
    and once over the parts' ends, so n entries take about 256 n + (n / 256)^2
    copies of a number. ``step`` must be associative, ``start`` its neutral value.
    """
    size = 256
    grow = lambda a, x: F.concat(a, F.array(step(F.coalesce(F.try_element_at(a, F.lit(-1)), start), x)))
    fold = lambda xs: F.aggregate(xs, F.slice(F.array(start), 1, 0), grow)
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: fold(F.slice(v, k * size + 1, size)))
    ends = lambda w: fold(F.transform(w, lambda p: F.element_at(p, -1)))
    joined = lambda s: F.flatten(F.transform(s["w"], lambda p, k: bound(F.when(k == 0, start).otherwise(F.get(s["e"], k - 1)), lambda b: F.transform(p, lambda x: step(b, x)))))
    long = lambda v: bound(parts(v), lambda w: bound(F.struct(w.alias("w"), ends(w).alias("e")), joined))
    return bound(values, lambda v: F.when(F.size(v) > size, long(v)).otherwise(fold(v)))


def line_breaks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def match_lines(text: Column, pattern: str | Column, unless: str | None = None) -> Column:
    """The 1-based lines on which the matches of a pattern begin, in order. A
    pattern of each row's own may be given as a column.
    ``unless``: a match counts only if what follows it, up to the next one,
    doesn't begin with this pattern."""
    pattern = F.lit(unbounded(pattern)) if isinstance(pattern, str) else pattern

    def placed(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]
        steps = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: line_breaks(p) + line_breaks(m))
        at = F.zip_with(found, running(steps, lambda a, x: a + x, F.lit(0)), lambda m, e: e - line_breaks(m) + 1)
        if unless is None:
            return at
        return F.array_compact(F.zip_with(at, F.slice(pieces, 2, F.size(found)), lambda n, p: F.when(~p.rlike(rf"\A(?:{unless})"), n)))

    matched = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(F.rlike(text, pattern), bound(matched, placed)).otherwise(F.array().cast("array<int>"))
