from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundlake.functions import exact, money


def evaluate(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, want", [(0.5, 0), (1.5, 200), (2.5, 200), (-2.5, -200), (7.0, 700), (None, None)])
def test_units_round_half_to_even(spark, x, want):
    assert evaluate(spark, money.unit_cents(F.lit(x).cast("double"))) == want


@pytest.mark.parametrize("x, want", [
    (1.005, 101), (1.004999, 100), (-1.005, -101), (1.0049995, 100), (2.0249995, 202), (-2.0249995, -202), (1.00500001, 101),
    (0.125, 13), (1234567.125, 123_456_713), (20_000_000_000.125, 2_000_000_000_013), (2.675, 268), (0.0, 0), (None, None),
    (9.5e12, 950_000_000_000_000), (-9.5e12, -950_000_000_000_000), (8_999_999_999_999.12, 899_999_999_999_912),
])
def test_cents_round_half_away_from_zero(spark, x, want):
    assert evaluate(spark, money.cents(F.lit(x).cast("double"))) == want


def test_label(spark):
    def text(amount, currency):
        return evaluate(spark, money.label(F.lit(amount).cast("decimal(38,2)"), F.lit(currency)))

    assert text("1234567890.00", "HUF") == "1234567890 HUF"
    assert text("-12.30", "EUR") == "-12.30 EUR"
    assert text(None, "EUR") is None


def test_formats(spark):
    assert evaluate(spark, money.plain_number(F.lit(17.0))) == "17"
    assert evaluate(spark, money.plain_number(F.lit(100.25))) == "100.25"
    assert evaluate(spark, money.thousands(F.lit(1234567.0))) == "1 234 567"
    assert evaluate(spark, money.percent(F.lit(12.3456))) == "1234.56%"
    assert evaluate(spark, money.percent(F.lit(None).cast("double"))) is None


def test_total_exceeds_a_long_and_keeps_every_digit(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000_001,), (9_000_000_000_000_000_001,), (-7,), (None,)], "x bigint")
    assert rows.agg(exact.total(F.col("x")).alias("x")).first()["x"] == Decimal("17999999999999999995")
    assert rows.filter("x is null").agg(exact.total(F.col("x")).alias("x")).first()["x"] is None


def test_product_total(spark):
    rows = spark.createDataFrame([(1_500_000, -2_000_001), (999_999, 999_999), (-3, 5)], "a bigint, b bigint")
    parts = exact.product_parts(F.col("a"), F.col("b"))
    got = rows.agg(exact.product_total(*[F.sum(p) for p in parts]).alias("x")).first()["x"]
    want = Decimal(1_500_000 * -2_000_001 + 999_999 * 999_999 - 15) / Decimal(10**12)
    assert got == want
