"""Derived views: lots, latest prices, rate series, current curve, time-weighted returns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.functions import exact, money
from fundlake.operators.range_join import join_dates_in_interval
from fundlake.operators.waves import union, waves
from fundlake.sources.tables import Tables, discard, freeing, stored


def account_currency(t: Tables) -> DataFrame:
    """One row per account: account_id, account_name, currency_id, currency."""
    currency = t.currency.select(F.col("id").alias("currency_id"), F.col("iso_code").alias("currency"))
    return t.account.select(
        F.col("id").alias("account_id"), "account_name", "currency_id"
    ).join(currency, "currency_id")


def priced_lots(t: Tables) -> DataFrame:
    """Every purchase with its cost: account_id, fund_id, value_date, share_amount, tr_value.

    The cost is shares times the fund's price of that day, NULL when the fund has no price that day.
    """
    price = t.fund_price.select("fund_id", "value_date", "price")
    return (
        t.fund_investment_transaction.select("account_id", "fund_id", "value_date", "share_amount")
        .join(price, ["fund_id", "value_date"], "left")
        .withColumn("tr_value", F.col("share_amount") * F.col("price"))
        .drop("price")
    )


def investment_lots(t: Tables) -> DataFrame:
    """One row per purchase with account, currency, fund, the account's first portfolio and the cost."""
    fund = t.fund.select(F.col("id").alias("fund_id"), "fund_name")
    first_portfolio = t.portfolio_x_account_rltnp.groupBy("account_id").agg(
        F.min("portfolio_id").alias("portfolio_id")
    )
    account = account_currency(t).join(first_portfolio, "account_id", "left")
    return (
        priced_lots(t)
        .join(fund, "fund_id")
        .join(account, "account_id")
        .select("account_id", "account_name", "fund_id", "fund_name", "currency", "currency_id",
                "portfolio_id", "value_date", "share_amount", "tr_value")
    )


def fund_price_recent(fund_price: DataFrame) -> DataFrame:
    """Latest price per fund: fund_id, price, value_date."""
    return fund_price.groupBy("fund_id").agg(
        F.max_by("price", "value_date").alias("price"), F.max("value_date").alias("value_date")
    )


def fx_series(t: Tables) -> DataFrame:
    """Values of all currency pairs: rate_id, rate_name, value_date, value."""
    pair = t.rate_fx.select(F.col("id").alias("rate_id")).join(
        t.rate.select(F.col("id").alias("rate_id"), "rate_name"), "rate_id"
    )
    return t.rate_value.join(pair, "rate_id").select("rate_id", "rate_name", "value_date", "value")


def interest_series(t: Tables) -> DataFrame:
    """Values of all interest rates: rate_id, rate_name, value_date, value."""
    rate = t.rate.filter(F.col("rate_type") == "interest").select(
        F.col("id").alias("rate_id"), "rate_name"
    )
    return t.rate_value.join(rate, "rate_id").select("rate_id", "rate_name", "value_date", "value")


def yield_curve_current(yield_curve: DataFrame) -> DataFrame:
    """The points of the latest date of every (currency, curve type)."""
    latest = yield_curve.groupBy("currency_id", "type").agg(F.max("value_date").alias("value_date"))
    return yield_curve.join(latest, ["currency_id", "type", "value_date"]).select(
        "currency_id", "type", "value_date", "tenor", "yield"
    )


SUMS = 1_000_000  # so many sums per key and day are always few
POINTS = 6_000_000  # prices that are sent to every task, at most: some 40 bytes each
TASK_SUMS = 1_000_000  # sums per key and day of one task, about
HEAVY = 50_000  # lots of a key that are not joined in one task


class Opening(NamedTuple):
    """What a series needs to go on from a day: all before it is summed up in one row per holding and key.

    ``since``: keys and the first day to compute; ``holdings``: keys, fund_id, held, held_more before that day;
    ``values``: keys, value, value_more at the end of the last day before it; ``quotes``: fund_id, price,
    price_more, the last price of each fund before the prices given.
    """

    since: DataFrame
    holdings: DataFrame
    values: DataFrame
    quotes: DataFrame


def quotes_of(prices: DataFrame) -> DataFrame:
    """Prices as millionths and what they have beyond: fund_id, date, price, price_more."""
    return prices.select(
        "fund_id", F.col("value_date").alias("date"), exact.millionths(F.col("price")).alias("price"),
        exact.beyond(F.col("price")).alias("price_more"),
    )


def bought_shares(lots: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares bought per key, fund and day, on days with a price: bought, bought_more."""
    return (
        lots.groupBy(*keys, "fund_id", F.col("value_date").alias("date"))
        .agg(F.sum(exact.millionths(F.col("share_amount"))).alias("bought"),
             F.sum(exact.beyond(F.col("share_amount"))).alias("bought_more"))
        .join(quotes.select("fund_id", "date"), ["fund_id", "date"], "left_semi")
    )


def daily_values(lots: DataFrame, prices: DataFrame, keys: Sequence[str], opening: Opening | None = None) -> DataFrame:
    """Market value of the holdings of each ``keys`` group per price day: value (exact), value_more, market_value,
    cash_flow, return.

    ``return`` is (market value - purchases of the day) / market value of the day before - 1, where market
    value is shares held times last known price, summed over funds. The first day has no return.

    Shares held change only on purchase days, so a holding is a few intervals of constant shares. Each
    fund price contributes the change of value it causes, and the running sum of changes is the market
    value: no grid of dates and funds is built, and the joined rows go straight into the daily sums.
    A purchase on a day without a price has no cost and is left out.

    Products of millionths are summed exactly; what prices and shares have beyond them goes along in double
    (the columns ending in ``_more``, zero for up to six decimals).

    With an ``opening`` the rows are those from each key's first day on, equal to those of a whole computation;
    lots and prices before it need not be given, but for the price before a fund's first given one.

    Lots and prices are stored once. Where a key has many lots, funds are worked on in waves, of which only sums per key
    and day stay. Where these sums would be more than the lots, keys are worked on one by one, see ``_changes_by_key``,
    but for the few that have very many lots.
    """
    keys = list(keys)
    lots = stored(lots.select(*keys, "fund_id", "value_date", "share_amount"), "lots")
    quotes = stored(quotes_of(prices), "quotes")
    if opening is not None:
        opening = Opening(*[stored(df, "opening") for df in opening])
    held = lots.select(*keys) if opening is None else lots.select(*keys).unionByName(opening.holdings.select(*keys))
    rows = stored(held.groupBy(*keys).agg(F.count("*").alias("_rows")), "keys")
    with freeing(quotes.sparkSession):
        last, days, points = quotes.agg(F.max("date"), F.countDistinct("date"), F.count("*")).first()
        sums, lot_count = days * rows.count(), lots.count()
    tasks = 0
    if sums > max(SUMS, lot_count) and points <= POINTS:
        tasks = max(int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sums // TASK_SUMS))
        heavy = stored(rows.filter(F.col("_rows") > HEAVY).select(*keys), "heavy")
        daily = _changes_by_key(*_of_keys(lots, opening, heavy, keys, "left_anti"), quotes, keys, last, tasks)
        if not heavy.isEmpty():
            some = _changes_by_fund(*_of_keys(lots, opening, heavy, keys, "left_semi"), quotes, keys, last)
            daily = daily.unionByName(some.repartition(tasks, *keys))  # dealt alike: what follows shuffles nothing
    else:
        daily = _changes_by_fund(lots, opening, quotes, keys, last)
    discard(lots, quotes, rows)
    daily = daily.select(*keys, "date", *[
        exact.product_total(*[F.col(f"{name}{i}") for i in range(3)]).alias(name)
        for name in ("change", "flow")
    ], "change_more", F.coalesce("flow_more", F.lit(0.0)).alias("flow_more"))
    if opening is not None:
        values = opening.values.select(
            *keys, F.lit(None).cast("date").alias("date"), F.col("value_more").alias("change_more"),
            F.col("value").alias("change"), F.lit(0).cast(exact.PRODUCT).alias("flow"), F.lit(0.0).alias("flow_more"))
        daily = daily.unionByName(values.repartition(tasks, *keys) if tasks else values)
    by_day = Window.partitionBy(*keys).orderBy("date")
    until_day = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = daily.select(
        *keys,
        "date",
        F.sum("change").over(until_day).cast(exact.PRODUCT).alias("value"),
        F.sum("change_more").over(until_day).alias("value_more"),
        (F.coalesce(F.col("flow"), F.lit(0)).cast("double") + F.col("flow_more")).alias("cash_flow"),
    ).withColumn("market_value", market_value())
    before = F.lag("market_value").over(by_day)
    return valued.withColumn(
        "return", F.try_divide(F.col("market_value") - F.col("cash_flow"), before) - 1
    ).filter(F.col("date").isNotNull())


def _of_wave(opening: Opening | None, wave: Column) -> Opening | None:
    """What the funds of a wave need of the opening."""
    return opening and opening._replace(holdings=opening.holdings.filter(wave), quotes=opening.quotes.filter(wave))


def _holdings(lots: DataFrame, quotes: DataFrame, keys: list[str], opening: Opening | None, last: object) -> DataFrame:
    """Intervals of constant shares; ``last`` is the last price day."""
    bought = bought_shares(lots, quotes, keys)
    if opening is not None:
        # holdings enter as a purchase before the first day that moves no cash
        entered_before = opening.holdings.join(opening.since, keys).select(
            *keys, "fund_id", F.date_sub("since", 1).alias("date"), F.col("held").alias("bought"),
            F.col("held_more").alias("bought_more"), "since")
        bought = (bought.join(opening.since, keys, "left").filter(F.col("since").isNull() | (F.col("date") >= F.col("since")))
                  .withColumn("since", F.lit(None).cast("date")).unionByName(entered_before))
    else:
        bought = bought.withColumn("since", F.lit(None).cast("date"))
    by_holding = Window.partitionBy(*keys, "fund_id").orderBy("date")
    return bought.select(
        *keys,
        "fund_id",
        F.coalesce("since", "date").alias("start"),
        F.col("since").isNotNull().alias("opened"),
        F.coalesce(F.lead("date").over(by_holding), F.date_add(F.lit(last).cast("date"), 1)).alias("until"),
        "bought",
        "bought_more",
        *[F.sum(b).over(by_holding.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(h)
          for b, h in (("bought", "held"), ("bought_more", "held_more"))],
    )


def _moves(quotes: DataFrame, opening: Opening | None) -> DataFrame:
    """Quotes with the fund's price before."""
    by_fund = Window.partitionBy("fund_id").orderBy("date")
    if opening is not None:
        quotes = quotes.unionByName(opening.quotes.withColumn("date", F.lit(None).cast("date")))  # sorted first
    return quotes.withColumns({
        "before": F.coalesce(F.lag("price").over(by_fund), F.lit(0)),
        "before_more": F.coalesce(F.lag("price_more").over(by_fund), F.lit(0.0)),
    }).filter(F.col("date").isNotNull())


_PARTS = [f"{name}{i}" for name in ("change", "flow") for i in range(3)] + ["change_more", "flow_more"]


def _summed(moved: DataFrame, keys: list[str]) -> DataFrame:
    """The changes of value that joined moves cause, per key and day, in parts that can be summed."""
    # On its day a purchase brings in the value of its shares at the price before that day's move.
    first_day = (F.col("date") == F.col("start")) & ~F.col("opened")
    parts = {
        "change": exact.product_parts(F.col("held"), F.col("price") - F.col("before")),
        "entered": exact.product_parts(F.col("bought"), F.col("before")),
        "flow": exact.product_parts(F.col("bought"), F.col("price")),
    }
    def rest(shares: str, price: Column, price_more: Column) -> Column:
        """The product of shares and price without the product of their millionths."""
        whole = F.col(shares) / 1e6 + F.col(f"{shares}_more")
        return whole * price_more + F.col(f"{shares}_more") * (price / 1e6)

    change_more = rest("held", F.col("price") - F.col("before"), F.col("price_more") - F.col("before_more"))
    entered_more = F.when(first_day, rest("bought", F.col("before"), F.col("before_more"))).otherwise(0.0)
    return moved.select(
        *keys,
        "date",
        (change_more + entered_more).alias("change_more"),
        F.when(first_day, rest("bought", F.col("price"), F.col("price_more"))).alias("flow_more"),
        *[(change + F.when(first_day, entered).otherwise(0)).alias(f"change{i}")
          for i, (change, entered) in enumerate(zip(parts["change"], parts["entered"]))],
        *[F.when(first_day, flow).alias(f"flow{i}") for i, flow in enumerate(parts["flow"])],
    ).groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in _PARTS])


def _of_keys(lots: DataFrame, opening: Opening | None, some: DataFrame, keys: list[str], how: str) -> tuple[DataFrame, Opening | None]:
    """Lots and opening holdings of some keys, or of the others; a NULL is a key like any other."""
    named = some.select(*[F.col(k).alias(f"_{k}") for k in keys])

    def of(df: DataFrame) -> DataFrame:
        return df.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)

    return of(lots), opening and opening._replace(holdings=of(opening.holdings))


def _changes_by_fund(lots: DataFrame, opening: Opening | None, quotes: DataFrame, keys: list[str], last: object) -> DataFrame:
    """The summed changes where keys are few: funds in waves, the sums of each wave stored."""
    parts = []
    for wave in waves(lots, "fund_id"):
        mine, prices, before = lots.filter(wave), quotes.filter(wave), _of_wave(opening, wave)
        holdings = _holdings(mine, prices, keys, before, last)
        moved = join_dates_in_interval(holdings, _moves(prices, before), ["fund_id"], "start", "until", "date")
        parts.append(stored(_summed(moved, keys), "changes"))
        discard(moved)
    return union(parts).groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in _PARTS])


def _changes_by_key(lots: DataFrame, opening: Opening | None, quotes: DataFrame, keys: list[str], last: object, tasks: int) -> DataFrame:
    """The summed changes where keys are many and each has few lots.

    Shuffling joined rows, or sums of some funds, would write many times the result. So holdings are dealt by key to
    ``tasks``, the funds' moves go to every task, packed by year, and a key's rows are joined, summed and handed on in
    one task; only holdings are shuffled. At most ``POINTS`` prices are sent around so.
    """
    parts = [stored(_holdings(lots.filter(w), quotes.filter(w), keys, _of_wave(opening, w), last), "holdings") for w in waves(lots, "fund_id")]
    moves = ["date", "price", "before", "price_more", "before_more"]
    packed = stored(
        _moves(quotes, opening).groupBy("fund_id", F.year("date").alias("_year")).agg(F.collect_list(F.struct(*moves)).alias("m"))
        .select("fund_id", "_year", *[F.col(f"m.{c}").alias(f"_{c}") for c in moves]), "moves")
    dealt = union(parts).filter(F.col("start") < F.col("until")).repartition(tasks, *keys).withColumn(
        "_year", F.explode(F.sequence(F.year("start"), F.year(F.date_sub("until", 1)))))
    met = dealt.join(F.broadcast(packed), ["fund_id", "_year"]).select("*", F.posexplode("_date").alias("_at", "date")).filter(
        (F.col("date") >= F.col("start")) & (F.col("date") < F.col("until")))
    return _summed(met.select(*dealt.columns, "date", *[F.get(f"_{c}", F.col("_at")).alias(c) for c in moves[1:]]), keys)


def market_value() -> Column:
    """The market value from the exact value and what goes along in double."""
    return F.col("value").cast("double") + F.col("value_more")


def daily_returns(lots: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time-weighted daily return of the holdings of each ``keys`` group: keys, date, market_value, cash_flow, return."""
    return daily_values(lots, prices, keys).drop("value", "value_more")


def portfolio_lots(t: Tables) -> DataFrame:
    """Purchases with the portfolios of their account; one row per lot and portfolio."""
    return t.fund_investment_transaction.select(
        "account_id", "fund_id", "value_date", "share_amount"
    ).join(t.portfolio_x_account_rltnp, "account_id")


def portfolio_returns(t: Tables) -> DataFrame:
    """Daily returns per portfolio: portfolio_id, portfolio, date, market_value, cash_flow, return."""
    return named_portfolio_returns(t, daily_returns(portfolio_lots(t), t.fund_price, ["portfolio_id"]))


def named_portfolio_returns(t: Tables, returns: DataFrame) -> DataFrame:
    """Series by portfolio_id with the portfolios' names."""
    name = t.portfolio.select(F.col("id").alias("portfolio_id"), F.col("name").alias("portfolio"))
    return returns.join(name, "portfolio_id").select(
        "portfolio_id", "portfolio", "date", "market_value", "cash_flow", "return"
    )


def account_returns(t: Tables) -> DataFrame:
    """Daily returns per portfolio and account.

    An account's series does not depend on the portfolio, so it is computed once and then repeated for
    every portfolio that holds the account.
    """
    return returns_by_member(t, daily_returns(t.fund_investment_transaction, t.fund_price, ["account_id"]))


def returns_by_member(t: Tables, returns: DataFrame) -> DataFrame:
    """Series by account_id, repeated for every portfolio that holds the account."""
    return returns.join(t.portfolio_x_account_rltnp, "account_id").select(
        "portfolio_id", "account_id", "date", "market_value", "cash_flow", "return"
    )


def statement_amounts(t: Tables) -> DataFrame:
    """Per account: invested, market value and profit/loss in cents, summed over lots rounded one by one.

    Both roundings are summed per account before the account's currency is joined, so the lots are
    combined on the map side and never shuffled by account. Priced lots are stored first, without what it took to find them.
    """
    priced = stored(priced_lots(t).select("account_id", "fund_id", "share_amount", "tr_value"), "lots")
    recent = fund_price_recent(t.fund_price).select("fund_id", F.col("price").alias("recent_price"))
    lots = priced.join(recent, "fund_id", "left").select(
        "account_id",
        F.col("tr_value").alias("cost"),
        (F.col("recent_price") * F.col("share_amount")).alias("worth"),
    )

    def sums(suffix: str, rounded) -> list[Column]:
        cost, worth = rounded(F.col("cost")), rounded(F.col("worth"))
        return [
            exact.total(cost).alias(f"invested_{suffix}"),
            exact.total(worth).alias(f"market_{suffix}"),
            exact.total(worth - cost).alias(f"profit_{suffix}"),
        ]

    by_account = lots.groupBy("account_id").agg(
        *sums("units", money.unit_cents), *sums("cents", money.cents)
    )

    def pick(measure: str) -> Column:
        return (
            F.when(F.col("currency") == money.HOME_CURRENCY, F.col(f"{measure}_units"))
            .otherwise(F.col(f"{measure}_cents"))
            .alias(measure)
        )

    return by_account.join(account_currency(t), "account_id").select(
        "account_id", "account_name", "currency", pick("invested"), pick("market"), pick("profit")
    )
