"""Selectors, review tables, paging and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.functions import money
from fundlake.operators.paging import rows_in_order
from fundlake.sources.tables import Tables

PROMPT = "please select.."
PAGE_ROWS = 10
STAMP = "yyyy-MM-dd HH:mm:ss"


def selector(rows: DataFrame, label: str) -> DataFrame:
    """Choices (label, id) with the empty prompt in front."""
    choices = rows.select(F.col(label).alias("label"), F.col("id").cast("string").alias("id"))
    prompt = rows.sparkSession.range(1).select(F.lit(PROMPT).alias("label"), F.lit("").alias("id"))
    return prompt.unionByName(choices)


def selector_currency(t: Tables) -> DataFrame:
    return selector(t.currency, "iso_code")


def selector_account(t: Tables) -> DataFrame:
    return selector(t.account, "account_name")


def selector_interest_rate(t: Tables) -> DataFrame:
    return selector(t.rate.filter(F.col("rate_type") == "interest"), "rate_name")


def selector_fund(t: Tables) -> DataFrame:
    return selector(t.fund, "fund_name")


def _stamp() -> Column:
    return F.date_format("last_modification", STAMP).alias("LastModification")


def _as(**names: str) -> list[Column]:
    return [F.col(column).alias(title) for title, column in names.items()]


def review_accounts(account: DataFrame) -> DataFrame:
    return account.select(
        *_as(AccountID="id", AccountName="account_name", TaxApplicable="tax_applicable",
             TaxRatePercentage="tax_rate_percent", CurrencyID="currency_id", OpeningDate="date_open"),
        _stamp(),
    )


def review_deposits(deposit: DataFrame) -> DataFrame:
    return deposit.select(
        *_as(DepositID="id", AccountID="account_id", ValueDate="value_date",
             MaturityDate="maturity_date", Amount="amount", IntRate="interest_rate",
             IntRateType="interest_rate_type", RateID="reference_rate_id",
             IntSpread="interest_rate_spread"),
        _stamp(),
    )


def review_funds(fund: DataFrame) -> DataFrame:
    return fund.orderBy("id").select(
        *_as(FundID="id", FundName="fund_name", ISIN="isin", CurrencyID="currency_id", SourceID="source_id"),
        _stamp(),
        F.date_format("inception_date", "yyyy-MM-dd").alias("InceptionDate"),
        *_as(Description="description"),
    )


def review_fund_prices(fund_price: DataFrame) -> DataFrame:
    ordered = fund_price.orderBy(
        F.desc_nulls_first("last_modification"), F.desc_nulls_first("value_date"), F.asc_nulls_last("fund_id")
    )
    return ordered.select(
        *_as(PriceID="id", ValueDate="value_date", FundID="fund_id", FundPrice="price"), _stamp()
    )


def review_rates(rate: DataFrame) -> DataFrame:
    return rate.select(*_as(RateID="id", RateName="rate_name", RateType="rate_type"), _stamp())


def review_rate_values(rate_value: DataFrame) -> DataFrame:
    ordered = rate_value.orderBy(F.desc_nulls_first("value_date"), F.asc_nulls_last("rate_id"))
    return ordered.select(
        *_as(RateValueID="id", RateID="rate_id", ValueDate="value_date", Value="value"), _stamp()
    )


def review_currencies(currency: DataFrame) -> DataFrame:
    return currency.orderBy("id").select(
        *_as(CurrencyID="id", ISO="iso_code", Description="description"), _stamp()
    )


def review_investments(transaction: DataFrame) -> DataFrame:
    return transaction.orderBy(F.desc_nulls_first("value_date"), "id").select(
        F.col("id").alias("TransactionID"),
        F.date_format("value_date", "yyyy-MM-dd").alias("ValueDate"),
        *_as(ShareAmount="share_amount", AccountID="account_id", FundID="fund_id"),
        _stamp(),
    )


def table_page(df: DataFrame, order_by: Sequence[str], page: int = 1, search: str = "",
               rows: int = PAGE_ROWS) -> DataFrame:
    """One page of a table: rows with ``search`` in any column, ignoring case, in the given order.

    A name in ``order_by`` with a leading minus sign is descending. End it with a unique column, or pages may
    overlap. However deep the page, only the range of rows that holds it is sorted.
    """
    if search:
        wanted = search.lower()
        hits = [F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)) for c in df.columns]
        df = df.filter(F.coalesce(F.greatest(*[F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False)))
    return rows_in_order(df, order_by, (page - 1) * rows, rows)


def format_percent_and_thousands(df: DataFrame, percents: Sequence[str] = (),
                                 wholes: Sequence[str] = ()) -> DataFrame:
    """Ratios as percent text with two digits, numbers as whole numbers with spaces."""
    return df.withColumns({
        **{c: money.percent(F.col(c)) for c in percents},
        **{c: money.thousands(F.col(c)) for c in wholes},
    })
