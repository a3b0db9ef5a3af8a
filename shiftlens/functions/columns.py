"""Column helpers for safe arithmetic and ordering.

ANSI mode is on in Spark 4, so a plain ``/`` by zero raises. The analysis rules are:

- ``ratio``   : ``x / 0`` counts as 0 (shares, weights of an empty baseline, ``0/0`` rates)
- ``percent`` : percent change is NULL when the baseline is 0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with 0 where the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(col_(num), col_(den)), F.lit(0.0))


def nullable_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``; NULL where the denominator is 0 (the NaN of the pandas form)."""
    return F.try_divide(col_(num), col_(den))


def percent_change(a: Column | str, b: Column | str) -> Column:
    """``(b - a) / a * 100``; NULL when ``a`` is 0."""
    a, b = col_(a), col_(b)
    return F.try_divide(b - a, a) * F.lit(100.0)


def abs_desc(c: Column | str) -> Column:
    """Sort key: largest absolute value first, NULL (NaN in pandas) last."""
    return F.abs(col_(c)).desc_nulls_last()


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(col_(c), F.lit(0.0))
