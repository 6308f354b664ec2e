"""Whole imports on a stored book."""

import pytest

from conftest import day
from fundlake.plans import jobs, statements
from fundlake.sources.tables import stored_tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def page(*lines, before=0):
    table = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in line) + "</tr>" for line in lines)
    return "<table><tr><td>x</td></tr></table>" * before + f"<table>{table}</table>"


@pytest.fixture
def stored(spark, small_book, tmp_path):
    folder = str(tmp_path / "app")
    for name in small_book:
        small_book[name].write.parquet(f"{folder}/{name}")
    return folder


def test_fund_prices_end_to_end(spark, stored, tmp_path):
    pages = spark.createDataFrame([
        (10, "fund 10", page(["Date", "Price", "NAV", "Div"], ["2021.01.04.", "9", "1,000", "0"],
                             ["2021.01.05.", "5.5", "1,000", "0"], before=6)),
        (11, "fund 11", page(["Date", "Price", "NAV", "Div"], ["2021.01.06.", "3", "1,000", "0"], before=6)),
    ], "fund_id bigint, fund_name string, html string")
    folder = str(tmp_path / "views")
    jobs.after_new_rows(spark, stored, folder)
    for _ in range(2):  # the second run finds nothing new
        fresh = jobs.store_rows(jobs.fund_prices_by_isin(pages, stored_tables(spark, stored)), "fund_price", stored, "2021-01-07 00:00:00")
        views = jobs.after_new_rows(spark, stored, folder, {"fund_price": fresh})
    t = stored_tables(spark, stored)
    assert t.fund_price.count() == 7
    assert t.fund_price.filter("last_modification is not null").select("id").distinct().count() == 2
    assert [c.kind for c in views.commits("portfolio_returns")] == ["whole", "later"]

    dates = {1: day("2021-01-05"), 2: day("2021-01-05"), 3: day("2019-01-01")}
    assert {r["id"]: r["last_valuation_date"] for r in t.portfolio.collect()} == dates
    jobs.store_valuation_dates(spark, stored)
    assert {r["id"]: r["last_valuation_date"] for r in stored_tables(spark, stored).portfolio.collect()} == dates
    t = stored_tables(spark, stored)
    returns = views.read("portfolio_returns", t)
    assert returns.filter("portfolio_id = 1 and date = '2021-01-06'").first()["market_value"] == 19.5
    assert rows(statements.portfolio_statement(t, returns=returns)) == rows(statements.portfolio_statement(t))


def test_fund_history_pages(spark, small_book):
    captions = [["c"]] * 5
    pages = spark.createDataFrame(
        [(11, "fund 11", page(*captions, ["NAV", "NAV Date"], ["7.5", "06.01.2020"], ["8.5", "07.01.2020"]))],
        "fund_id bigint, fund_name string, html string")
    assert rows(jobs.fund_prices_by_history(pages, small_book)) == [(11, day("2020-01-07"), 8.5)]


def test_rates(spark, small_book):
    fx = spark.createDataFrame([("EUR", page(["7 January 2020", "310.5"])), ("XXX", page(["7 January 2020", "1"]))],
                               "iso_code string, html string")
    assert rows(jobs.fx_rates(fx, small_book)) == [(102, day("2020-01-07"), 310.5)]
    interest = spark.createDataFrame([("BASE", page(["7 January 2020", "0.9%"])), ("BASE", None)],
                                     "rate_name string, html string")
    assert rows(jobs.interest_rates(interest, small_book)) == [(201, day("2020-01-07"), 0.9)]


def test_sheets(spark, small_book):
    index = spark.createDataFrame(
        [("1", "2020-01-06", "EUR/HUF", "", "", "5"), ("2", "2020-01-08", "BASE", "", "", "6"), ("3", "2020-01-09", "BASE", "", "", None)],
        "a string, b string, c string, d string, e string, f string")
    assert rows(jobs.index_values(index, small_book)) == [(201, day("2020-01-08"), 6.0)]
    zero = spark.createDataFrame([("2020-01-08", "30", "n", "1.5"), ("2020-01-08", "60", None, "1.5")],
                                 "a string, b string, c string, d string")
    point = (0, 30.0, "HUF Zero Coupon", day("2020-01-08"), 1.5)
    assert rows(jobs.zero_coupon_curve(zero, small_book)) == [point]
    known = spark.createDataFrame([point], small_book.yield_curve.select(
        "currency_id", "tenor", "type", "value_date", "yield").schema)
    assert rows(jobs.zero_coupon_curve(zero, small_book.replace(yield_curve=known))) == []
    benchmark = spark.createDataFrame(
        [tuple(["x", "2020-01-08", code, "x", "x", "x", "2.5"] + ["x"] * 5) for code in ("Y3", "?")],
        ", ".join(f"c{i} string" for i in range(12)))
    assert rows(jobs.benchmark_curve(benchmark, small_book)) == [
        (0, 1095.0, "HUF Benchmark Rates", day("2020-01-08"), 2.5), (0, None, "HUF Benchmark Rates", day("2020-01-08"), 2.5)]
