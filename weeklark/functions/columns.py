"""Small idioms for arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Without this, an array expression that a lambda refers to is evaluated
    again for every element that the lambda sees.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def steps(n: Column) -> Column:
    """Array 0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def at(xs: Column, i: Column) -> Column:
    """Element by 0-based index; the index must be in range."""
    return F.element_at(xs, (i + 1).cast("int"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def four_digits(x: Column) -> Column:
    """C's ``%.4f`` of a finite number of 0 or more: its exact value to the nearest, ties to the even digit.

    Spark's formats round the shortest decimal that reads back as the double.
    Here the rest is held against the tie at half a digit: both parts of it
    times 20,000 are exact.
    """
    whole = F.floor(x)
    rest = x - whole
    high = rest.cast("float").cast("double")
    digits = F.floor(rest * 10000)
    over = (high * 20000 - (2 * digits + 1)) + (rest - high) * 20000
    rounded = digits + F.when(over > 0, 1).when(over == 0, digits % 2).otherwise(0)
    shown = F.concat((whole + F.floor(rounded / 10000)).cast("string"), F.lit("."), F.lpad((rounded % 10000).cast("string"), 4, "0"))
    return F.when(x < 2.0**53, shown).otherwise(F.call_function("format_number", x, F.lit("0.0000")))


def nan() -> Column:
    return F.lit(NAN)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with every column evaluated once.

    A projection on top of another one is merged into it, and then a lambda
    evaluates the array expression that it refers to for each element. A
    generator of one row in between keeps the two apart. The first column, the
    key, passes by it, so what is known of its partitioning stays known.
    """
    key, *others = df.columns
    return df.select(key, F.inline(F.array(F.struct(*[F.col(c) for c in others]))))
