"""Incremental control tables and loads from staging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.functions import money
from fundlake.plans import views
from fundlake.sources import monthly
from fundlake.sources.tables import Tables, stored

ISO_DATE = "yyyy-MM-dd"


def _home_pairs(t: Tables) -> DataFrame:
    """Currency pairs into the home currency: rate_id, currency_id, iso_code."""
    home = t.currency.filter(F.col("iso_code") == money.HOME_CURRENCY).select("id").scalar()
    currency = t.currency.select(F.col("id").alias("currency_id"), "iso_code")
    return (
        t.rate_fx.filter(F.col("to_currency_id") == home)
        .select(F.col("id").alias("rate_id"), F.col("from_currency_id").alias("currency_id"))
        .join(currency, "currency_id")
    )


def _last_values(rate_value: DataFrame) -> DataFrame:
    return rate_value.groupBy("rate_id").agg(F.max("value_date").alias("last_value"))


def control_fx(t: Tables, include_new: bool = False) -> DataFrame:
    """Next import date per foreign currency held by an account.

    A pair without any value is left out unless ``include_new``. Accounts and values are reduced to one
    row per currency and rate before they meet.
    """
    opened = t.account.groupBy("currency_id").agg(F.min("date_open").alias("date_open_min"))
    pairs = _home_pairs(t).filter(F.col("iso_code") != money.HOME_CURRENCY).join(opened, "currency_id")
    values = _last_values(t.rate_value).withColumnRenamed("last_value", "last_fx_rate_value")
    return pairs.join(values, "rate_id", "left" if include_new else "inner").select(
        "iso_code",
        F.col("rate_id").alias("id"),
        F.coalesce(F.date_add("last_fx_rate_value", 1), "date_open_min").alias("import_date"),
        "date_open_min",
        "last_fx_rate_value",
    )


def control_interest(t: Tables) -> DataFrame:
    """Earliest deposit and next import date per interest rate that a deposit refers to."""
    used = t.deposit.groupBy(F.col("reference_rate_id").alias("id")).agg(
        F.min("value_date").alias("date_open")
    )
    rate = t.rate.filter(F.col("rate_type") == "interest").select("id", "rate_name")
    values = _last_values(t.rate_value).withColumnRenamed("rate_id", "id")
    return used.join(rate, "id").join(values, "id", "left").select(
        "id",
        "rate_name",
        "date_open",
        F.coalesce(F.date_add("last_value", 1), "date_open").alias("import_date"),
    )


def control_funds(t: Tables, wanted: Column) -> DataFrame:
    """Next import date of the funds that satisfy ``wanted``: the day after the latest price, or the
    inception date of a fund without prices."""
    recent = views.fund_price_recent(t.fund_price).select(
        F.col("fund_id"), F.col("value_date").alias("last_price")
    )
    fund = t.fund.filter(wanted).select(
        F.col("id").alias("fund_id"), "isin", "fund_name", "source_id", "inception_date"
    )
    return fund.join(recent, "fund_id", "left").select(
        "fund_id",
        "isin",
        "fund_name",
        "source_id",
        F.date_add(F.coalesce("last_price", F.date_sub("inception_date", 1)), 1).alias("import_date_from"),
    )


def isin_in_country(code: str) -> Column:
    return F.col("isin").startswith(code)


def described_as(prefix: str) -> Column:
    return F.col("description").startswith(prefix)


def new_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str], date: str = "value_date",
             dedup_batch: bool = False) -> DataFrame:
    """The rows of ``batch`` whose ``keys`` are absent from ``target``; a NULL key is never present.

    The batch is staged once, so its pages are parsed once. The target is scanned from the batch's first date
    on only, since earlier rows cannot match; one kept by month has only these months' files read. Duplicates within
    the batch stay unless ``dedup_batch``, which keeps the least row of each key.
    """
    keys = list(keys)
    staged = stored(batch, "batch")
    first = staged.agg(F.min(date)).first()[0]
    known = monthly.since(target, first, date).select(*keys)
    fresh = staged.join(known, keys, "left_anti")
    if not dedup_batch:
        return fresh
    others = [c for c in batch.columns if c not in keys]
    least = fresh.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"))
    return least.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in batch.columns])


def exclude_known_dates(batch: DataFrame, target: DataFrame, entity: str = "fund_id",
                        date: str = "date", target_date: str = "value_date") -> DataFrame:
    """Drop fetched rows whose date is stored for the same entity; a NULL date equals a NULL date.

    The batch is staged once; of the target only rows without a date or from the batch's first date on are scanned.
    """
    staged = stored(batch, "batch")
    first = staged.agg(F.min(date)).first()[0]
    wanted = F.col(target_date).isNull()
    if first is not None:
        wanted = wanted | (F.col(target_date) >= F.lit(first))
        if monthly.MONTH in target.columns:
            target = target.filter((F.col(monthly.MONTH) >= first.strftime("%Y-%m")) | (F.col(monthly.MONTH) == monthly.NO_MONTH))
    known = target.filter(wanted).select(F.col(entity).alias("_entity"), F.col(target_date).alias("_date"))
    same = (F.col(entity) == F.col("_entity")) & F.col(date).eqNullSafe(F.col("_date"))
    return staged.join(known, same, "left_anti")


def _staged_rates(staging: DataFrame) -> DataFrame:
    return staging.select(
        "rate_name",
        F.try_to_date("value_date", ISO_DATE).alias("value_date"),
        F.col("value").try_cast("double").alias("value"),
    )


def load_fx(staging: DataFrame, t: Tables) -> DataFrame:
    """Staged rates named by currency -> rows for ``rate_value``; unknown currencies drop out."""
    pairs = _home_pairs(t).select(F.col("iso_code").alias("rate_name"), "rate_id")
    return _staged_rates(staging).join(pairs, "rate_name").select("rate_id", "value_date", "value")


def load_interest(staging: DataFrame, t: Tables) -> DataFrame:
    """Staged rates by name -> rows for ``rate_value``; an unknown name gives a NULL rate."""
    rate = t.rate.select("rate_name", F.col("id").alias("rate_id"))
    return _staged_rates(staging).join(rate, "rate_name", "left").select(
        "rate_id", "value_date", "value"
    )


def load_index_dedup(staging: DataFrame, t: Tables, dedup_batch: bool = False) -> DataFrame:
    """As ``load_interest``, without rows whose (rate, date) is stored."""
    return new_rows(load_interest(staging, t), t.rate_value, ["rate_id", "value_date"],
                    dedup_batch=dedup_batch)


def load_fund_price_dedup(staging: DataFrame, fund_price: DataFrame,
                          dedup_batch: bool = False) -> DataFrame:
    """Staged fund prices -> new rows for ``fund_price`` by (fund, date)."""
    return new_rows(typed_fund_prices(staging), fund_price, ["fund_id", "value_date"], dedup_batch=dedup_batch)


def typed_fund_prices(staging: DataFrame) -> DataFrame:
    """Staged texts as fund_id, value_date, price; bad text becomes NULL."""
    return staging.select(
        F.col("fund_id").try_cast("bigint").alias("fund_id"),
        F.try_to_date("date", ISO_DATE).alias("value_date"),
        F.col("price").try_cast("double").alias("price"),
    )


def load_yield_curve_dedup(staging: DataFrame, yield_curve: DataFrame,
                           dedup_batch: bool = False) -> DataFrame:
    """Staged curve points -> new rows for ``yield_curve`` by (currency, tenor, type, date)."""
    batch = staging.select(
        F.col("currency_id").try_cast("int").alias("currency_id"),
        F.col("tenor").try_cast("double").alias("tenor"),
        "type",
        F.try_to_date("date", ISO_DATE).alias("value_date"),
        F.col("yield").try_cast("double").alias("yield"),
    )
    return new_rows(batch, yield_curve, ["currency_id", "tenor", "type", "value_date"],
                    dedup_batch=dedup_batch)


def update_valuation_date(t: Tables) -> DataFrame:
    """``portfolio`` with last_valuation_date set to the earliest latest-price date of its held funds.

    Portfolios without priced holdings keep their date.
    """
    held = views.portfolio_lots(t).select("portfolio_id", "fund_id").distinct()
    recent = views.fund_price_recent(t.fund_price).select("fund_id", "value_date")
    valued = held.join(recent, "fund_id").groupBy(F.col("portfolio_id").alias("id")).agg(
        F.min("value_date").alias("valued_on")
    )
    return t.portfolio.join(valued, "id", "left").select(
        "id", "name", "description",
        F.coalesce("valued_on", "last_valuation_date").alias("last_valuation_date"),
    )


def with_valuation_dates(t: Tables) -> Tables:
    """The tables with ``portfolio`` brought up to date."""
    return t.replace(portfolio=update_valuation_date(t))
