"""Money: per-lot rounding, exact sums, labels.

A lot's amount is rounded to whole units in HUF (half to even) and to cents in any other currency (half
away from zero). Rounded amounts are counted in cents as whole numbers, so sums are exact and do not
depend on row order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundlake.functions import exact

HOME_CURRENCY = "HUF"
AMOUNT = "decimal(38,2)"


def unit_cents(x: Column) -> Column:
    """``x`` in whole units, half to even, counted in cents."""
    return F.rint(x).cast("bigint") * 100


def cents(x: Column) -> Column:
    """``x`` with two digits, half away from zero; counted in cents.

    The number is what its shortest decimal text says, as in a cast to text and then to numeric. Below 1e9 the error
    of ``100 * x`` in double is far below a thousandth, so only values that near a tie need the decimal of the text.
    """
    hundredfold = F.abs(x) * 100
    clear = (hundredfold < 1e11) & (F.abs(hundredfold - F.floor(hundredfold) - 0.5) > 1e-3)
    whole = F.floor(hundredfold + 0.5)
    exact_way = (F.round(x.cast("decimal(38,18)"), 2) * 100).cast("bigint")
    return F.when(clear, F.when(x < 0, -whole).otherwise(whole)).otherwise(exact_way)


def lot_cents(x: Column, currency: Column) -> Column:
    """One lot's amount, rounded as its currency demands, counted in cents."""
    return F.when(currency == HOME_CURRENCY, unit_cents(x)).otherwise(cents(x))


def amount(x: Column) -> Column:
    """Cents as an amount with two digits."""
    return (x.cast(exact.WHOLE) * F.lit(Decimal("0.01"))).cast(AMOUNT)


def label(x: Column, currency: Column) -> Column:
    """Amount text: ``1234 HUF`` or ``12.30 EUR``; NULL when the amount is NULL."""
    units = x.cast("decimal(38,0)").cast("string")
    text = F.when(currency == HOME_CURRENCY, units).otherwise(x.cast(AMOUNT).cast("string"))
    return F.concat(text, F.lit(" "), currency)


def plain_number(x: Column) -> Column:
    """Decimal text without trailing zeros: 17, 2.5."""
    text = x.cast("decimal(28,6)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def thousands(x: Column) -> Column:
    """Whole number with a space as thousands mark."""
    return F.translate(F.format_number(x, 0), ",", " ")


def percent(x: Column) -> Column:
    """Ratio as percent text with two digits; NULL stays NULL."""
    return F.concat(F.translate(F.format_number(x * 100, 2), ",", ""), F.lit("%"))
