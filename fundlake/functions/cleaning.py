"""Imported rows to staging rows: text to dates and numbers, tenors, constants.

Text that is no date or number becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.functions import money
from fundlake.sources.positional import by_position

# Date patterns of the sources, curve names, days per tenor code.
LONG_DATE = "d MMMM yyyy"
DOTTED_DATE = "yyyy.MM.dd."
SWISS_DATE = "dd.MM.yyyy"
ZERO_COUPON = "HUF Zero Coupon"
BENCHMARK = "HUF Benchmark Rates"
TENOR_DAYS = {"M3": 90, "M6": 180, "M12": 365, "Y3": 1095, "Y5": 1825, "Y10": 3650, "Y15": 5475}


def date_of(text: str, pattern: str) -> Column:
    return F.try_to_date(F.col(text), pattern)


def number_of(text: str, drop: str = "") -> Column:
    """Number from text after removing the characters ``drop``; NaN, Infinity and suffixed forms are no numbers."""
    cleaned = F.trim(F.translate(F.col(text), drop, "") if drop else F.col(text))
    return F.when(cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cleaned.try_cast("double"))


def clean_fx_rows(rows: DataFrame, date: str, value: str, name: str) -> DataFrame:
    """Exchange rates: value_date, value, rate_name (the currency the row was fetched for)."""
    return rows.select(
        date_of(date, LONG_DATE).alias("value_date"), number_of(value).alias("value"),
        F.col(name).alias("rate_name"),
    )


def clean_ir_rows(rows: DataFrame, date: str, value: str, name: str) -> DataFrame:
    """Interest rates: as exchange rates, with the percent sign removed."""
    return rows.select(
        date_of(date, LONG_DATE).alias("value_date"), number_of(value, "%").alias("value"),
        F.col(name).alias("rate_name"),
    )


def typed_fund_rows(rows: DataFrame) -> DataFrame:
    """Fund page rows with typed date, price, net asset value (thousands commas removed), dividend."""
    return rows.withColumns({
        "date": date_of("date", DOTTED_DATE),
        "price": number_of("price"),
        "net_asset_value": number_of("net_asset_value", ","),
        "paid_dividend": number_of("paid_dividend"),
    })


def clean_fund_price_rows(rows: DataFrame) -> DataFrame:
    """Fund prices for staging: date, fund_id, fund_name, price."""
    return (
        typed_fund_rows(rows)
        .drop("net_asset_value", "paid_dividend")
        .select("date", "fund_id", "fund_name", "price")
    )


def clean_cs_price_rows(rows: DataFrame, date: str = "NAV Date", price: str = "NAV") -> DataFrame:
    """Prices of all fetched funds in one frame; the price stays text until the load."""
    return rows.select(
        date_of(date, SWISS_DATE).alias("date"), "fund_id", "fund_name", F.col(price).alias("price")
    )


def _with_curve(points: DataFrame, currency: DataFrame, curve: str) -> DataFrame:
    home = currency.filter(F.col("iso_code") == money.HOME_CURRENCY).select("id").scalar()
    return points.withColumn("type", F.lit(curve)).withColumn("currency_id", home)


def clean_yield_curve(sheet: DataFrame, currency: DataFrame, curve: str = ZERO_COUPON) -> DataFrame:
    """Curve points: columns 1, 2 and 4 of the rows complete in columns 1 to 4, curve and currency."""
    points = by_position(sheet, [1, 2, 4], [1, 2, 3, 4], ["date", "tenor", "yield"])
    return _with_curve(points, currency, curve)


def tenor_days(code: Column) -> Column:
    """Days of a tenor code; NULL for any other text."""
    days = F.lit(None).cast("int")
    for name, count in TENOR_DAYS.items():
        days = F.when(code == name, count).otherwise(days)
    return days


def tenor_code_to_days(sheet: DataFrame, currency: DataFrame, curve: str = BENCHMARK) -> DataFrame:
    """Curve points: date, tenor code and yield in columns 2, 3 and 7, the code as days."""
    points = by_position(sheet, [2, 3, 7], names=["date", "tenor", "yield"])
    return _with_curve(points.withColumn("tenor", tenor_days(F.col("tenor"))), currency, curve)


def clean_index_rows(sheet: DataFrame) -> DataFrame:
    """Index values: columns 2, 6 and 3 of the rows that have a value in column 6."""
    return by_position(sheet, [2, 6, 3], [6], ["value_date", "value", "rate_name"])
