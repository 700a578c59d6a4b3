"""Exact rounding for money and shares: integers all the way to the last step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(38,0)"


def cents(amount: Column) -> Column:
    return (amount * 100).cast(CENTS)


def half_up(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator / denominator of two whole numbers, rounded half up; null over zero."""
    scale = 10**digits
    bottom = denominator.cast(CENTS)
    top = (numerator.cast(CENTS) * F.lit(2 * scale) + bottom).cast(CENTS)
    whole = F.call_function("div", top, (bottom * 2).cast(CENTS))
    return F.when(bottom != 0, whole.cast("double") / scale)


def mean_money(total: Column, count: Column) -> Column:
    """A mean of money to two decimals."""
    return half_up(cents(total), count * 100, 2)


def share(part: Column, whole: Column) -> Column:
    """A share of money to four decimals."""
    return half_up(cents(part), cents(whole), 4)
