"""Derived views and analytics."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake import fixtures
from fundlake.catalog import Entry, on_tables, rounded
from fundlake.catalog.oracle import label
from fundlake.operators.loads import update_valuation_date, with_valuation_dates
from fundlake.plans import series, statements, views
from fundlake.sources.tables import Tables, freeing, scratch, stored


_STATEMENT = ", ".join(
    f"{label(f'sum({x})', 'currency')} {name}"
    for name, x in (("invested_amount", "cost"), ("market_value", "worth"), ("profit_loss", "worth-cost"))
)


def _returns(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "return"), "market_value", "cash_flow", digits=2)


def _series_keys(t: Tables) -> DataFrame:
    """The slices of all split series: currency of the performance series, portfolio of the
    distribution, fund of the price development."""
    parts = [
        ("currency", series.performance_currencies(with_valuation_dates(t))),
        ("portfolio", series.slice_keys(statements.portfolio_distribution(t, ordered=False), "portfolio_id")),
        ("fund", series.developed_funds(t)),
    ]
    frames = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("slice"))
              for kind, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _slices(t: Tables) -> DataFrame:
    """The performance series written once by currency; the rows of every slice read back by itself."""
    spark = t.portfolio.sparkSession
    dated = t.replace(portfolio=stored(update_valuation_date(t), "portfolio"))
    performance, path = series.portfolio_performance_ts(dated, ordered=False), scratch(spark, "slices")
    series.write_slices(performance, "currency", path)
    with freeing(spark):
        keys = sorted(r[0] for r in series.performance_currencies(dated).collect())  # currencies, a list people choose from
    slices = [series.slice_of(series.read_slices(performance, path), "currency", key) for key in keys]
    return functools.reduce(DataFrame.unionByName, slices, performance.limit(0))

def _converted(x: str) -> str:
    """A lot's amount in whole home units."""
    return f"cast(round_even(cast({x} as double)*coalesce(fx.value,1),0) as decimal(28,0))"


ENTRIES: dict[str, Entry] = {
    "investment_lots": Entry(
        on_tables(lambda t: rounded(views.investment_lots(t), "tr_value", digits=4)),
        "select account_id, account_name, fund_id, fund_name, currency, currency_id, portfolio_id,"
        " value_date, share_amount, round(tr_value,4) tr_value from {lot_vw}",
    ),
    "fund_price_recent": Entry(
        on_tables(lambda t: views.fund_price_recent(t.fund_price)),
        "select fund_id, price, value_date from {recent_vw}",
    ),
    "fx_series": Entry(
        on_tables(views.fx_series),
        "select v.rate_id, r.rate_name, v.value_date, v.value"
        " from {rate_value} v join {rate_fx} x on v.rate_id=x.id join {rate} r on r.id=x.id",
    ),
    "interest_series": Entry(
        on_tables(views.interest_series),
        "select v.rate_id, r.rate_name, v.value_date, v.value"
        " from {rate_value} v join {rate} r on v.rate_id=r.id where r.rate_type='interest'",
    ),
    "yield_curve_current": Entry(
        on_tables(lambda t: views.yield_curve_current(t.yield_curve)),
        'select currency_id, type, value_date, tenor, yield from'
        ' (select *, rank() over (partition by currency_id, type order by value_date desc) rk'
        ' from {yield_curve}) c where rk=1',
    ),
    "portfolio_returns": Entry(
        on_tables(lambda t: _returns(views.portfolio_returns(t))),
        'select p.id portfolio_id, p.name portfolio, r.date, round(r.mv,2) market_value,'
        ' round(r.cf,2) cash_flow, round(r.ret,6) "return"'
        " from {portfolio_return} r join {portfolio} p on p.id=r.key_id",
    ),
    "account_returns": Entry(
        on_tables(lambda t: _returns(views.account_returns(t))),
        'select x.portfolio_id, x.account_id, r.date, round(r.mv,2) market_value, round(r.cf,2) cash_flow,'
        ' round(r.ret,6) "return"'
        " from {account_return} r join {portfolio_x_account_rltnp} x on x.account_id=r.key_id",
    ),
    "update_valuation_date": Entry(
        on_tables(update_valuation_date),
        "select id, name, description, last_valuation_date from {portfolio_now}",
    ),
    "portfolio_performance_ts": Entry(
        on_tables(lambda t: series.portfolio_performance_ts(with_valuation_dates(t))),
        "select * from {performance} order by currency desc, portfolio, date",
    ),
    "annualized_return_expanding": Entry(
        on_tables(lambda t: rounded(
            series.annualized_return_expanding(views.portfolio_returns(t)), "ann_yield_pct")),
        "select portfolio, date, round(ann_yield_pct,6) ann_yield_pct from {expanding_return}",
    ),
    "recent_annualized_return": Entry(
        on_tables(lambda t: rounded(series.recent_annualized_return(t), "ann_yield_pct")),
        "select portfolio, date, round(ann_yield_pct,6) ann_yield_pct from {recent_return}",
    ),
    "lot_performance": Entry(
        on_tables(lambda t: rounded(statements.lot_performance(t), "yield", "annualized_yield")),
        f"""select portfolio_id, account_id, account_name account, fund_name fund, currency, value_date,
               regexp_replace(cast(cast(share_amount as decimal(28,6)) as varchar), '\\.?0+$', '')
               || ' pc' purchased_shares,
               {label('cost', 'currency')} invested_amount, {label('(worth-cost)', 'currency')} profit_loss,
               round((raw_worth-tr_value)/nullif(tr_value,0),6) yield,
               case when recent_date-value_date+1>=365
                    then round(pow(round_even(raw_worth,0)/nullif(round_even(tr_value,0),0),
                                   365/cast(recent_date-value_date+1 as double))-1,6) end annualized_yield
        from {{valued_lot}}""",
    ),
    "account_statement": Entry(
        on_tables(statements.account_statement),
        f"""select account_name account, currency, {_STATEMENT}
        from {{valued_lot}} group by account_id, account_name, currency""",
    ),
    "portfolio_statement": Entry(
        on_tables(lambda t: rounded(statements.portfolio_statement(t), "annualized_yield")),
        f"""select name portfolio, currency, {label('paid', 'currency')} invested_amount,
               {label('present', 'currency')} market_value, {label('gain', 'currency')} profit_loss,
               (select round(ann_yield_pct/100,6) from {{recent_return}} where portfolio=name) annualized_yield
        from (select portfolio_id, currency, sum(paid) paid, sum(present) present, sum(gain) gain
              from (select account_id, currency, sum(cost) paid, sum(worth) present, sum(worth-cost) gain
                    from {{valued_lot}} group by all) by_account
                   natural join {{portfolio_x_account_rltnp}} group by all) by_portfolio
             join {{portfolio}} on id=portfolio_id""",
    ),
    "portfolio_distribution": Entry(
        on_tables(lambda t: rounded(statements.portfolio_distribution(t), "val", digits=2)),
        """select p.id portfolio_id, p.name portfolio_name, l.fund_name,
               round(cast(sum(cast(l.share_amount as decimal(18,9))*cast(r.price as decimal(18,9)))
                     as double),2) val
        from {portfolio} p join {portfolio_x_account_rltnp} m on m.portfolio_id=p.id
             join {lot_vw} l on l.account_id=m.account_id join {recent_vw} r on r.fund_id=l.fund_id
        group by p.id, p.name, l.fund_name
        qualify count(*) over (partition by p.id) > 1""",
    ),
    "key_figures": Entry(
        on_tables(statements.key_figures),
        f"""select cast(sum({_converted('l.cost')}) as double) total_init_investment,
               cast(sum({_converted('l.worth')}) as double) total_market_value,
               cast(sum({_converted('l.worth')}-{_converted('l.cost')}) as double) total_yield
        from {{valued_lot}} l left join
             (select x.from_currency_id, v.value_date, v.value
              from {{rate_fx}} x join {{rate_value}} v on v.rate_id=x.id
                   join {{currency}} home on home.id=x.to_currency_id and home.iso_code='HUF') fx
             on fx.from_currency_id=l.currency_id and fx.value_date=l.recent_date""",
    ),
    "portfolio_directory": Entry(
        on_tables(lambda t: statements.portfolio_directory(update_valuation_date(t))),
        "select name fund_portfolio, description portfolio_description,"
        " strftime(last_valuation_date,'%Y-%m-%d') valuation_date from {portfolio_now} order by name",
    ),
    "fund_price_development": Entry(
        on_tables(lambda t: rounded(series.fund_price_development(t), "change_pct", "purchase")),
        """select f.id, f.fund_name, q.value_date, q.price,
               round((q.price/b.base-1)*100,6) change_pct,
               case when x.id is not null then round((q.price/b.base-1)*100,6) end purchase,
               case when x.id is not null then q.price end purchase_price
        from {fund} f
             join (select fp.fund_id, d.first_day, arg_min(fp.price, fp.value_date) base
                   from {fund_price} fp join (select fund_id, min(value_date) first_day
                                              from {fund_investment_transaction} group by fund_id) d
                        on d.fund_id=fp.fund_id and d.first_day<=fp.value_date
                   group by fp.fund_id, d.first_day) b on b.fund_id=f.id
             join {fund_price} q on q.fund_id=f.id and q.value_date>=b.first_day
             left join {fund_investment_transaction} x on x.fund_id=f.id and x.value_date=q.value_date""",
    ),
    "fx_history": Entry(
        on_tables(series.fx_history),
        "select v.rate_id, r.rate_name, v.value_date, v.value"
        " from {rate_value} v join {rate_fx} x on v.rate_id=x.id join {rate} r on r.id=x.id"
        " order by v.rate_id, v.value_date",
    ),
    "account_balance_history": Entry(
        on_tables(lambda t: series.account_balance_history(t, fixtures.AS_OF)),
        f"""select m.reporting_period, a.id account_id, a.account_name, c.iso_code currency,
               cast(sum(cast(x.amount as decimal(28,2))) as double) balance
        from (select last_day(cast(d as date)) reporting_period
              from (select unnest(range((select date_trunc('month', min(value_date))::timestamp from {{cash_transaction}}),
                                        timestamp '{fixtures.AS_OF}', interval 1 month)) d)) m
             join {{cash_transaction}} x on x.value_date<=m.reporting_period
             join {{account}} a on a.id=x.account_id join {{currency}} c on c.id=a.currency_id
        group by m.reporting_period, a.id, a.account_name, c.iso_code""",
    ),
    "series_slices": Entry(on_tables(_slices), "select * from {performance}"),
    "series_split_by_currency": Entry(
        on_tables(_series_keys),
        """select distinct 'currency' kind, currency slice from {performance}
        union all
        select 'portfolio', cast(portfolio_id as varchar) from
          (select portfolio_id, count(distinct fund_id) n
           from {fund_investment_transaction} join {portfolio_x_account_rltnp} using (account_id)
           where fund_id in (select fund_id from {fund_price}) group by portfolio_id) d where n>1
        union all
        select distinct 'fund', cast(tx.fund_id as varchar)
        from {fund_investment_transaction} tx join {fund_price} fp
             on tx.fund_id=fp.fund_id and fp.value_date>=tx.value_date""",
    ),
}
