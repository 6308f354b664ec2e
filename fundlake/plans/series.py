"""Time series: performance, annualized returns, price development, FX and balance history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.functions import exact, money
from fundlake.operators.range_join import join_dates_in_interval
from fundlake.operators.repeat import repeat_rows
from fundlake.operators.waves import union, waves
from fundlake.plans import views
from fundlake.sources.tables import Tables, discard, freeing, stored

TRADING_DAYS = 252
BALANCE = "decimal(38,2)"


def portfolio_performance_ts(t: Tables, ordered: bool = True) -> DataFrame:
    """Accumulated yield and cumulative balance per portfolio, price date and currency.

    ``t.portfolio`` must carry valuation dates; later dates and portfolios without one are left out.
    A fund without a price on a date does not count on that date.

    Rounding is per lot, so lots are combined only when portfolio, currency, fund and share amount agree:
    their rounded values are equal on every date. Such a group is a number of lots and a cost that grow on
    purchase days. Between two purchase days one row stands for all lots of the group.

    Priced lots, members and prices are stored once; then funds are worked on in waves, of which only sums per portfolio,
    date and currency stay.
    """
    portfolio = stored(t.portfolio.select(F.col("id").alias("portfolio_id"), F.col("name").alias("portfolio"),
                                          F.col("last_valuation_date").alias("last")), "portfolio")
    members = stored(
        t.portfolio_x_account_rltnp.join(portfolio.select("portfolio_id", "last").filter(F.col("last").isNotNull()), "portfolio_id")
        .join(views.account_currency(t).select("account_id", "currency"), "account_id"), "members")
    lots = stored(views.priced_lots(t), "lots")
    prices = stored(t.fund_price.select("fund_id", F.col("value_date").alias("date"), "price"), "prices")
    by = ["portfolio_id", "date", "currency"]
    sums = union([_performance_sums(lots.filter(wave), members, prices.filter(wave), by) for wave in waves(lots, "fund_id")])
    discard(lots, members, prices)
    cost = exact.join_halves(F.sum("cost_high"), F.sum("cost_low"))
    worth = exact.join_halves(F.sum("worth_high"), F.sum("worth_low"))
    result = (
        sums.groupBy(*by).agg(worth.alias("worth"), cost.alias("cost"))
        .join(portfolio.select("portfolio_id", "portfolio"), "portfolio_id")
        .select(
            "portfolio_id",
            "portfolio",
            "date",
            "currency",
            money.amount(F.col("worth") - F.col("cost")).cast("double").alias("accumulated_yield"),
            money.amount(F.col("cost")).cast("double").alias("cumulative_balance"),
        )
    )
    return result.orderBy(F.desc("currency"), "portfolio", "date") if ordered else result


def _performance_sums(lots: DataFrame, members: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Worth and cost of the lots per portfolio, price date and currency, in halves; stored."""
    held = lots.join(members, "account_id").filter(F.col("value_date") <= F.col("last"))
    group = ["portfolio_id", "last", "currency", "fund_id", "share_amount"]
    bought = held.groupBy(*group, "value_date").agg(
        F.count("tr_value").alias("lots"),
        exact.total(money.lot_cents(F.col("tr_value"), F.col("currency"))).alias("cost"),
    )
    by_group = Window.partitionBy(*group).orderBy("value_date")
    so_far = by_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    intervals = bought.select(
        *group,
        F.col("value_date").alias("start"),
        F.coalesce(F.lead("value_date").over(by_group), F.date_add("last", 1)).alias("until"),
        F.nullif(F.sum("lots").over(so_far), F.lit(0)).alias("lots"),
        F.sum("cost").over(so_far).cast(exact.WHOLE).alias("cost"),
    ).select(
        "*",
        (F.col("cost") / exact.MILLION).cast("bigint").alias("cost_high"),
        (F.col("cost") % exact.MILLION).cast("bigint").alias("cost_low"),
    ).drop("cost")
    worth = money.lot_cents(F.col("price") * F.col("share_amount"), F.col("currency"))
    joined = join_dates_in_interval(intervals, prices, ["fund_id"], "start", "until", "date")
    sums = stored(
        joined.select(*by, "lots", "cost_high", "cost_low", worth.alias("worth"))
        .groupBy(*by)
        .agg(
            F.sum(exact.div(F.col("worth"), exact.MILLION) * F.col("lots")).alias("worth_high"),
            F.sum(exact.rem(F.col("worth"), exact.MILLION) * F.col("lots")).alias("worth_low"),
            F.sum("cost_high").alias("cost_high"),
            F.sum("cost_low").alias("cost_low"),
        ), "sums")
    discard(joined)
    return sums


def annualized_return_expanding(returns: DataFrame) -> DataFrame:
    """Annualized return in percent up to every day, from the 252nd return of a portfolio on.

    ``returns`` has portfolio, date and return. One pass per portfolio over its days.
    """
    known = returns.filter(F.col("return").isNotNull()).select("portfolio", "date", "return")
    so_far = Window.partitionBy("portfolio").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    growth = F.product(1 + F.col("return")).over(so_far)
    days = F.count("return").over(so_far)
    return (
        known.select("portfolio", "date", growth.alias("growth"), days.alias("days"))
        .filter(F.col("days") >= TRADING_DAYS)
        .select(
            "portfolio",
            "date",
            ((F.pow("growth", F.lit(float(TRADING_DAYS)) / F.col("days")) - 1) * 100)
            .alias("ann_yield_pct"),
        )
    )


def recent_annualized_return(t: Tables, returns: DataFrame | None = None) -> DataFrame:
    """The latest annualized return of every portfolio that has one.

    ``returns`` may be the stored copy of the portfolio returns.
    """
    expanding = annualized_return_expanding(views.portfolio_returns(t) if returns is None else returns)
    return expanding.groupBy("portfolio").agg(
        F.max("date").alias("date"), F.max_by("ann_yield_pct", "date").alias("ann_yield_pct")
    )


def fund_price_development(t: Tables) -> DataFrame:
    """Prices of each fund from its first purchase on, with the change since then in percent.

    ``purchase`` and ``purchase_price`` are set on purchase days; a day with n purchases gives n rows.
    Purchases are counted per fund and day before the join, the n rows come from the count.
    """
    bought = t.fund_investment_transaction.groupBy("fund_id", "value_date").agg(
        F.count("*").alias("purchases")
    )
    first = bought.groupBy("fund_id").agg(F.min("value_date").alias("first_date"))
    fund = t.fund.select(F.col("id").alias("fund_id"), "fund_name").join(first, "fund_id")
    since = Window.partitionBy("fund_id").orderBy("value_date")
    prices = (
        t.fund_price.select("fund_id", "value_date", "price")
        .join(fund, "fund_id")
        .filter(F.col("value_date") >= F.col("first_date"))
        .withColumn("base", F.first("price").over(since))
    )
    change = (F.try_divide(F.col("price"), F.col("base")) - 1) * 100
    purchased = F.col("purchases").isNotNull()
    rows = prices.join(bought, ["fund_id", "value_date"], "left").select(
        F.col("fund_id").alias("id"),
        "fund_name",
        "value_date",
        "price",
        change.alias("change_pct"),
        F.when(purchased, change).alias("purchase"),
        F.when(purchased, F.col("price")).alias("purchase_price"),
        F.coalesce("purchases", F.lit(1)).alias("copies"),
    )
    return repeat_rows(rows, "copies")


def fx_history(t: Tables, ordered: bool = True) -> DataFrame:
    """All currency pairs by rate and date."""
    result = views.fx_series(t)
    return result.orderBy("rate_id", "value_date") if ordered else result


def account_balance_history(t: Tables, as_of: Column | str, ordered: bool = True) -> DataFrame:
    """Month-end balance per account, from its first transaction to the month before ``as_of``.

    Amounts are summed per account and month; a running sum gives the balance at the end of each active
    month, which then holds until the month before the next active one.
    """
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    last_month = F.add_months(F.trunc(day, "MM"), -1)
    monthly = (
        t.cash_transaction.select(
            "account_id", F.trunc("value_date", "MM").alias("month"),
            F.col("amount").cast("decimal(28,2)").alias("amount"),
        )
        .filter(F.col("month") <= last_month)
        .groupBy("account_id", "month")
        .agg(F.sum("amount").cast(BALANCE).alias("amount"))
    )
    by_account = Window.partitionBy("account_id").orderBy("month")
    balances = monthly.select(
        "account_id",
        "month",
        F.sum("amount").over(
            by_account.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ).cast("double").alias("balance"),
        F.coalesce(F.add_months(F.lead("month").over(by_account), -1), last_month).alias("until"),
    )
    account = views.account_currency(t).select("account_id", "account_name", "currency")
    result = balances.join(account, "account_id").select(
        F.explode(F.sequence("month", "until", F.expr("interval 1 month"))).alias("month"),
        "account_id",
        "account_name",
        "currency",
        "balance",
    ).select(F.last_day("month").alias("reporting_period"), "account_id", "account_name", "currency",
             "balance")
    return result.orderBy("reporting_period", "account_id") if ordered else result


def slice_keys(df: DataFrame, column: str) -> DataFrame:
    """The distinct values that a series is split by."""
    return df.select(column).distinct()


def performance_currencies(t: Tables) -> DataFrame:
    """The currencies of the performance series, found before prices multiply the lots: those of which some fund
    has a price between its first purchase and the valuation date of a portfolio."""
    portfolio = t.portfolio.select(F.col("id").alias("portfolio_id"), F.col("last_valuation_date").alias("last"))
    members = t.portfolio_x_account_rltnp.join(portfolio.filter(F.col("last").isNotNull()), "portfolio_id").join(
        views.account_currency(t).select("account_id", "currency"), "account_id")
    fund = t.fund.select(F.col("id").alias("fund_id"))
    held = (t.fund_investment_transaction.join(members, "account_id").join(fund, "fund_id", "left_semi")
            .groupBy("fund_id", "currency", "last").agg(F.min("value_date").alias("first")))
    quote = t.fund_price.select(F.col("fund_id").alias("_fund"), F.col("value_date").alias("_date"))
    priced = (F.col("fund_id") == F.col("_fund")) & (F.col("_date") >= F.col("first")) & (F.col("_date") <= F.col("last"))
    return held.join(quote, priced, "left_semi").select("currency").distinct()


def developed_funds(t: Tables) -> DataFrame:
    """The funds of the price development: those with a price on or after their first purchase."""
    first = t.fund_investment_transaction.groupBy("fund_id").agg(F.min("value_date").alias("first"))
    last = t.fund_price.groupBy(F.col("fund_id").alias("_fund")).agg(F.max("value_date").alias("last"))
    fund = t.fund.select(F.col("id").alias("fund_id"))
    found = first.join(last, (F.col("fund_id") == F.col("_fund")) & (F.col("last") >= F.col("first")))
    return found.join(fund, "fund_id", "left_semi").select(F.col("fund_id").alias("id"))


def slice_of(df: DataFrame, column: str, value: object) -> DataFrame:
    """One slice of a series; of a stored one only that folder is read."""
    return df.filter(F.col(column) == value)


def write_slices(df: DataFrame, column: str, path: str) -> None:
    """All slices in one write, one folder per value; each value's rows are dealt to as few tasks as they need."""
    with freeing(df.sparkSession):
        df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def read_slices(df: DataFrame, path: str) -> DataFrame:
    """The stored slices of a series with the columns of ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
