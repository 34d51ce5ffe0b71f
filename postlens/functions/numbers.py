"""Rounding and percentages as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to even, scale back: the rounding of numpy and pandas."""
    scale = 10.0**digits
    return F.rint(value.cast("double") * scale) / scale


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent; null when there is nothing to divide by."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return round_half_even(share * 100, digits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body mentions it.

    A column named twice is copied twice when Catalyst pushes a filter through
    the projection that defines it; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def to_number(value: Column) -> Column:
    """Numbers stay, text that is no number becomes null."""
    return value.try_cast("double")


def total(df: DataFrame, agg: Column) -> Column:
    """A one-value aggregate of df as a scalar subquery (no join, evaluated once)."""
    return df.agg(agg.alias("total")).scalar()


def one_row(df: DataFrame, **columns: Column) -> DataFrame:
    """A single row of scalar expressions, evaluated on the session of df."""
    return df.sparkSession.range(1).select(*[c.alias(n) for n, c in columns.items()])
