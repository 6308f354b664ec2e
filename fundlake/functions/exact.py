"""Exact sums of fixed-point numbers in long arithmetic.

Sums of wide decimals cost most of the time of an aggregation over many rows. Here a whole number is
summed as quotient and remainder of a million, and a product of two numbers with six decimals as three
partial products; each part is a long. The decimal is built once per result row. In ANSI mode, the default,
a sum that leaves the range (9e24 for totals) raises an overflow error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1_000_000
WHOLE = "decimal(38,0)"
PRODUCT = "decimal(38,12)"


def div(x: Column, n: int) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", x, F.lit(n).cast("bigint"))


def rem(x: Column, n: int) -> Column:
    """Remainder of ``div``."""
    return x % F.lit(n).cast("bigint")


def millionths(x: Column) -> Column:
    """A double as whole number of millionths."""
    return F.rint(x * 1e6).cast("bigint")


def beyond(x: Column) -> Column:
    """What a double has beyond its millionths: exactly zero for a number of at most six decimals."""
    return x - F.rint(x * 1e6) / 1e6


def join_halves(high: Column, low: Column) -> Column:
    """Whole number from summed quotients and remainders."""
    return (high.cast("decimal(28,0)") * F.lit(MILLION).cast("decimal(8,0)") + low.cast("decimal(20,0)")).cast(WHOLE)


def total(x: Column) -> Column:
    """Sum of whole numbers (long); NULL when there is none."""
    return join_halves(F.sum(div(x, MILLION)), F.sum(rem(x, MILLION)))


def product_parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Product of two numbers of millionths as parts of weight 1, 1e-6 and 1e-12."""
    a1, a0 = div(a, MILLION), rem(a, MILLION)
    b1, b0 = div(b, MILLION), rem(b, MILLION)
    return a1 * b1, a1 * b0 + a0 * b1, a0 * b0


def product_total(first: Column, second: Column, third: Column) -> Column:
    """The number from its three summed parts."""
    def scaled(x: Column, digits: int) -> Column:
        unit = F.lit(Decimal(1).scaleb(-digits))
        return (x.cast("decimal(20,0)") * unit).cast("decimal(31,12)")

    return (scaled(first, 0) + scaled(second, 6) + scaled(third, 12)).cast(PRODUCT)
