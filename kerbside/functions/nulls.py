"""Two-valued membership, division and distinct counts with the data's null rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is FALSE, never null, for a null value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def one_of(c: Column | str, values: Iterable) -> Column:
    """Membership as a row filter: null counts as no. Unlike ``in_set`` it is a plain ``IN``,
    which the scan can use to skip data; do not negate it."""
    return as_col(c).isin(list(values))


def not_in_set(c: Column | str, values: Iterable) -> Column:
    """Negated membership; null rows are kept."""
    return ~in_set(c, values)


def unless_all(*conditions: Column) -> Column:
    """Keep a row unless every condition is TRUE (null counts as keep)."""
    return ~F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def unless_any(*conditions: Column) -> Column:
    """Keep a row unless some condition is TRUE (null counts as keep)."""
    return ~F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division where x/0 is signed infinity and 0/0 is NaN instead of an error."""
    num, den = as_col(num).cast("double"), as_col(den).cast("double")
    return (
        F.when(den != 0, F.try_divide(num, den))
        .when((den == 0) & (num > 0), F.lit(float("inf")))
        .when((den == 0) & (num < 0), F.lit(float("-inf")))
        .when((den == 0) & (num == 0), F.lit(float("nan")))
    )


def n_distinct(c: Column | str) -> Column:
    """Distinct count in which null is one more value.

    Spark plans the distinct part in two shuffles, the first on keys + value, so a
    group holding a large part of the rows is spread over all tasks.
    """
    c = as_col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
