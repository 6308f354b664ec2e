"""The daily imports as whole: fetched pages or sheets to new table rows, then what depends on them.

Fetched pages of all entities come as one DataFrame; nothing loops over funds or rates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions import cleaning
from fundlake.operators import loads, records
from fundlake.plans.refresh import VIEWS, StoredViews, refresh_views
from fundlake.sources import html, tables
from fundlake.sources.tables import Tables, stored_tables

# Where the sources keep their table, and its titles.
FUND_TABLE, FUND_CELLS = 7, ["date", "price", "net_asset_value", "paid_dividend"]
HISTORY_TITLE_ROW, HISTORY_TITLES = 6, ["NAV Date", "NAV"]


def fx_rates(pages: DataFrame, t: Tables) -> DataFrame:
    """Pages (iso_code, html) -> rows for ``rate_value``."""
    rows = html.extract_html_table(pages, 1, ["iso_code"], ["date", "value"])
    return loads.load_fx(cleaning.clean_fx_rows(rows, "date", "value", "iso_code"), t)


def interest_rates(pages: DataFrame, t: Tables) -> DataFrame:
    """Pages (rate_name, html) -> rows for ``rate_value``."""
    rows = html.extract_html_table(pages, 1, ["rate_name"], ["date", "value"])
    return loads.load_interest(cleaning.clean_ir_rows(rows, "date", "value", "rate_name"), t)


def index_values(sheet: DataFrame, t: Tables) -> DataFrame:
    """Index sheet -> new rows for ``rate_value``."""
    return loads.load_index_dedup(cleaning.clean_index_rows(sheet), t)


def zero_coupon_curve(sheet: DataFrame, t: Tables) -> DataFrame:
    """Zero coupon sheet -> new rows for ``yield_curve``."""
    return loads.load_yield_curve_dedup(cleaning.clean_yield_curve(sheet, t.currency), t.yield_curve)


def benchmark_curve(sheet: DataFrame, t: Tables) -> DataFrame:
    """Benchmark sheet -> new rows for ``yield_curve``."""
    return loads.load_yield_curve_dedup(cleaning.tenor_code_to_days(sheet, t.currency), t.yield_curve)


def fund_prices_by_isin(pages: DataFrame, t: Tables) -> DataFrame:
    """Pages (fund_id, fund_name, html), the first row of the table being titles -> new rows for
    ``fund_price``; dates stored for the fund are dropped before staging."""
    return loads.load_fund_price_dedup(loads.exclude_known_dates(fetched_fund_prices(pages), t.fund_price), t.fund_price)


def fetched_fund_prices(pages: DataFrame) -> DataFrame:
    """Pages (fund_id, fund_name, html) -> cleansed rows: date, fund_id, fund_name, price."""
    rows = html.extract_html_table(pages, FUND_TABLE, ["fund_id", "fund_name"], FUND_CELLS)
    return cleaning.clean_fund_price_rows(rows.filter(F.col("row_no") > 1))


def fund_prices_by_history(pages: DataFrame, t: Tables) -> DataFrame:
    """Pages (fund_id, fund_name, html) with titles inside the table -> new rows for ``fund_price``."""
    rows = html.extract_titled_table(pages, 1, ["fund_id", "fund_name"], HISTORY_TITLE_ROW, HISTORY_TITLES)
    return loads.load_fund_price_dedup(cleaning.clean_cs_price_rows(rows), t.fund_price)


def store_rows(rows: DataFrame, name: str, directory: str, loaded_at: str | None = None) -> DataFrame:
    """Append ``rows`` to a stored table of the data model and return them as stored; columns they lack are filled: ``id``
    with new numbers, ``last_modification`` with the given or the current time, others with NULL."""
    return records.store(rows, name, directory, loaded_at)


def store_valuation_dates(spark: SparkSession, directory: str) -> None:
    """Replace the stored ``portfolio`` by one with current valuation dates."""
    tables.stage(loads.update_valuation_date(stored_tables(spark, directory)), "portfolio", directory)


def after_new_rows(spark: SparkSession, directory: str, views_directory: str, new: Mapping[str, DataFrame] | None = None,
                   names: Sequence[str] = VIEWS) -> StoredViews:
    """What follows new prices, purchases, rates or curve points: the stored views, then valuation dates from their state.

    ``new`` has the stored rows that came in, by table; without it everything is computed anew.
    """
    stored = refresh_views(spark, views_directory, stored_tables(spark, directory), new, names)
    if "portfolio_returns" in names:
        tables.stage(stored.valuation_dates(stored_tables(spark, directory)), "portfolio", directory)
    return stored
