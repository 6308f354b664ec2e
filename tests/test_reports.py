"""Literal results on the small book."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import day
from fundlake.operators.loads import update_valuation_date, with_valuation_dates
from fundlake.plans import series, statements, views


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lots_keep_a_purchase_without_price(small_book):
    lots = {r["fund_id"]: r for r in views.investment_lots(small_book).collect()}
    assert lots[12]["tr_value"] is None
    assert (lots[10]["portfolio_id"], lots[10]["currency"]) == (1, "HUF")


def test_account_statement(small_book):
    # HUF: 2.5 -> 2, 3.5 -> 4 twice; latest price 4.5 -> 4 each. EUR: 1.005 -> 1.01, latest 2.00.
    assert rows(statements.account_statement(small_book)) == [
        ("euro", "EUR", "1.01 EUR", "2.00 EUR", "0.99 EUR"),
        ("home", "HUF", "10 HUF", "12 HUF", "2 HUF"),
    ]


def test_account_with_unpriced_lots_only_has_null_labels(small_book):
    lots = small_book.fund_investment_transaction.filter("fund_id = 12")
    got = rows(statements.account_statement(small_book.replace(fund_investment_transaction=lots)))
    assert got == [("euro", "EUR", None, None, None)]


def test_portfolio_statement_counts_an_account_in_both_portfolios(small_book):
    assert rows(statements.portfolio_statement(small_book)) == [
        ("P1", "EUR", "1.01 EUR", "2.00 EUR", "0.99 EUR", None),
        ("P1", "HUF", "10 HUF", "12 HUF", "2 HUF", None),
        ("P2", "HUF", "10 HUF", "12 HUF", "2 HUF", None),
    ]


def test_distribution_drops_portfolios_with_one_fund(small_book):
    assert rows(statements.portfolio_distribution(small_book)) == [
        (1, "P1", "fund 10", 13.5), (1, "P1", "fund 11", 2.0),
    ]


def test_key_figures_use_the_rate_of_the_last_price_date(small_book):
    # EUR lot: 1.01 * 300 = 303, 2.00 * 300 = 600; HUF lots at 1.
    assert rows(statements.key_figures(small_book)) == [(313.0, 612.0, 299.0)]
    without = small_book.replace(rate_value=small_book.rate_value.limit(0))
    assert rows(statements.key_figures(without)) == [(11.0, 14.0, 3.0)]


@pytest.mark.parametrize("recent, annualized", [("2020-12-30", None), ("2020-12-31", pytest.approx(1.0))])
def test_annualized_yield_needs_365_days(small_book, spark, recent, annualized):
    # Purchase on 2020-01-02 counts as day one: 364 or 365 days.
    prices = spark.createDataFrame(
        [(10, day("2020-01-02"), 2.0), (10, day(recent), 4.0)],
        "fund_id bigint, value_date date, price double")
    lots = small_book.fund_investment_transaction.filter("id = 1")
    got = statements.lot_performance(
        small_book.replace(fund_price=prices, fund_investment_transaction=lots)).first()
    assert (got["yield"], got["annualized_yield"]) == (1.0, annualized)
    assert (got["purchased_shares"], got["invested_amount"], got["profit_loss"]) == ("1 pc", "2 HUF", "2 HUF")


def test_valuation_date_is_the_earliest_latest_price(small_book):
    got = {r["id"]: r["last_valuation_date"] for r in update_valuation_date(small_book).collect()}
    assert got == {1: day("2020-01-06"), 2: day("2021-01-04"), 3: day("2019-01-01")}


def test_performance_series_has_no_fill(small_book):
    got = rows(series.portfolio_performance_ts(with_valuation_dates(small_book)))
    # P1 ends on 2020-01-06. Fund 10 has no price that day, so HUF has no row there.
    assert got == [
        (1, "P1", day("2020-01-02"), "HUF", 0.0, 2.0),
        (1, "P1", day("2020-01-03"), "HUF", 2.0, 10.0),
        (2, "P2", day("2020-01-02"), "HUF", 0.0, 2.0),
        (2, "P2", day("2020-01-03"), "HUF", 2.0, 10.0),
        (2, "P2", day("2021-01-04"), "HUF", 2.0, 10.0),
        (1, "P1", day("2020-01-03"), "EUR", 0.0, 1.01),
        (1, "P1", day("2020-01-06"), "EUR", 0.99, 1.01),
    ]


def test_daily_returns(small_book):
    got = [(r["date"], r["market_value"], r["cash_flow"], r["return"])
           for r in views.portfolio_returns(small_book).filter("portfolio_id = 1").orderBy("date").collect()]
    assert got == [
        (day("2020-01-02"), 2.5, 2.5, None),
        # 3 shares at 3.5 and 1 at 1.005, of which 7.0 and 1.005 were bought that day
        (day("2020-01-03"), 11.505, 8.005, pytest.approx(0.4)),
        (day("2020-01-06"), 12.5, 0.0, pytest.approx(12.5 / 11.505 - 1)),
        (day("2021-01-04"), 15.5, 0.0, pytest.approx(0.24)),
    ]


@pytest.mark.parametrize("days, results", [(251, 0), (252, 1), (253, 2)])
def test_expanding_return_starts_with_252_days(spark, days, results):
    first = datetime.date(2020, 1, 1)
    data = [("P", first, None)] + [("P", first + datetime.timedelta(i), 0.001) for i in range(1, days + 1)]
    returns = spark.createDataFrame(data, "portfolio string, date date, return double")
    got = series.annualized_return_expanding(returns).collect()
    assert len(got) == results
    for row in got:
        assert row["ann_yield_pct"] == pytest.approx((1.001**252 - 1) * 100)


def test_price_development_repeats_purchase_days(small_book):
    got = rows(series.fund_price_development(small_book).filter("id = 10").orderBy("value_date"))
    day_two = (10, "fund 10", day("2020-01-03"), 3.5, pytest.approx(40.0), pytest.approx(40.0), 3.5)
    assert got == [
        (10, "fund 10", day("2020-01-02"), 2.5, 0.0, 0.0, 2.5),
        day_two,
        day_two,
        (10, "fund 10", day("2021-01-04"), 4.5, pytest.approx(80.0), None, None),
    ]


def test_balance_history_holds_between_active_months(book):
    t = book(
        currency=[{"id": 0, "iso_code": "HUF"}],
        account=[{"id": 1, "account_name": "a", "currency_id": 0}, {"id": 2, "account_name": "b", "currency_id": 0}],
        cash_transaction=[
            {"account_id": 1, "amount": 10.1, "value_date": day("2020-01-31")},
            {"account_id": 1, "amount": 0.2, "value_date": day("2020-03-15")},
            {"account_id": 2, "amount": 5.0, "value_date": day("2020-04-30")},
            {"account_id": 2, "amount": 9.0, "value_date": day("2020-05-01")},
        ],
    )
    got = rows(series.account_balance_history(t, "2020-05-20").select("reporting_period", "account_id", "balance"))
    assert got == [
        (day("2020-01-31"), 1, 10.1), (day("2020-02-29"), 1, 10.1), (day("2020-03-31"), 1, 10.3),
        (day("2020-04-30"), 1, 10.3), (day("2020-04-30"), 2, 5.0),
    ]


def test_series_accept_empty_tables(book):
    t = book()
    assert rows(series.fx_history(t)) == []
    assert rows(series.portfolio_performance_ts(t)) == []
    assert rows(series.account_balance_history(t, "2020-05-20")) == []
    assert rows(statements.key_figures(t)) == [(None, None, None)]


def test_slices(small_book, spark, tmp_path):
    performance = series.portfolio_performance_ts(with_valuation_dates(small_book), ordered=False)
    keys = {r[0] for r in series.slice_keys(performance, "currency").collect()}
    assert keys == {"HUF", "EUR"}
    series.write_slices(performance, "currency", str(tmp_path / "slices"))
    stored = spark.read.parquet(str(tmp_path / "slices"))
    for key in keys:
        assert stored.filter(F.col("currency") == key).count() == series.slice_of(performance, "currency", key).count()


def test_returns_keep_digits_beyond_millionths(book):
    t = book(
        fund_price=[{"fund_id": 1, "value_date": day("2020-01-02"), "price": 0.0000014},
                    {"fund_id": 1, "value_date": day("2020-01-03"), "price": 0.0000016}],
        fund_investment_transaction=[
            {"id": 1, "value_date": day("2020-01-02"), "share_amount": 3.0000005, "account_id": 1, "fund_id": 1}],
    )
    got = views.daily_returns(t.fund_investment_transaction, t.fund_price, ["account_id"]).orderBy("date").collect()
    assert got[0]["market_value"] == pytest.approx(3.0000005 * 0.0000014, rel=1e-9)
    assert got[1]["return"] == pytest.approx(0.142857, abs=1e-6)
