"""Views in plain SQL that several oracle queries share, and the rendering of an oracle query."""

from __future__ import annotations

from fundlake import fixtures

_UNITS = "cast(round_even({x},0) as decimal(28,2))"
_CENTS = "round(cast(cast({x} as varchar) as decimal(38,18)),2)"


def amount(x: str, currency: str) -> str:
    """Rounded amount of one lot."""
    return (f"case when {currency}='HUF' then {_UNITS.replace('{x}', x)}"
            f" else {_CENTS.replace('{x}', x)} end")


def label(x: str, currency: str) -> str:
    """Amount text with currency."""
    return (f"case when {currency}='HUF' then cast(cast({x} as decimal(38,0)) as varchar)"
            f" else cast(cast({x} as decimal(38,2)) as varchar) end || ' ' || {currency}")


VIEWS: dict[str, str] = {
    "lot_vw": """
        select a.id account_id, a.account_name, f.id fund_id, f.fund_name, c.iso_code currency,
               c.id currency_id, pm.portfolio_id, tx.value_date, tx.share_amount,
               tx.share_amount*fp.price tr_value
        from {fund_investment_transaction} tx
             join {account} a on tx.account_id=a.id
             join {currency} c on a.currency_id=c.id
             join {fund} f on tx.fund_id=f.id
             left join (select account_id, min(portfolio_id) portfolio_id
                        from {portfolio_x_account_rltnp} group by account_id) pm on pm.account_id=a.id
             left join {fund_price} fp on tx.fund_id=fp.fund_id and tx.value_date=fp.value_date""",
    "recent_vw": """
        select fund_id, price, value_date from {fund_price} fp
        where value_date=(select max(value_date) from {fund_price} x where x.fund_id=fp.fund_id)""",
    # Lots with their rounded cost and present worth.
    "valued_lot": f"""
        select l.*, r.price*l.share_amount raw_worth, r.value_date recent_date,
               {amount('l.tr_value', 'l.currency')} cost,
               {amount('r.price*l.share_amount', 'l.currency')} worth
        from {{lot_vw}} l left join {{recent_vw}} r on r.fund_id=l.fund_id""",
    "portfolio_now": """
        select id, name, description,
               coalesce((select min(r.value_date)
                         from {portfolio_x_account_rltnp} m
                              join {fund_investment_transaction} x on x.account_id=m.account_id
                              join {recent_vw} r on r.fund_id=x.fund_id
                         where m.portfolio_id=p.id), last_valuation_date) last_valuation_date
        from {portfolio} p""",
    # Gain and cost of every account and price day, all lots bought by then.
    "account_gain": f"""
        select account_id, currency, day, sum(worth-cost) gain, sum(cost) paid
        from (select l.account_id, l.currency, q.value_date as day,
                     {amount('l.tr_value', 'l.currency')} cost,
                     {amount('q.price*l.share_amount', 'l.currency')} worth
              from {{lot_vw}} l join {{fund_price}} q on q.fund_id=l.fund_id and q.value_date>=l.value_date) held
        group by all""",
    "performance": """
        select g.portfolio_id, now.name portfolio, g.day date, g.currency,
               cast(g.gain as double) accumulated_yield, cast(g.paid as double) cumulative_balance
        from (select portfolio_id, currency, day, sum(gain) gain, sum(paid) paid
              from {account_gain} natural join {portfolio_x_account_rltnp} group by all) g
             join {portfolio_now} now on now.id=g.portfolio_id and now.last_valuation_date>=g.day""",
    # Market value on every day one of the held funds has a price: shares and price as of that day.
    "portfolio_day": """
        select portfolio_id key_id, fund_id, value_date, sum(share_amount) shares
        from {fund_investment_transaction} join {portfolio_x_account_rltnp} using (account_id)
        group by all""",
    "account_day": """
        select account_id key_id, fund_id, value_date, sum(share_amount) shares
        from {fund_investment_transaction} group by all""",
}


def _returns(day: str) -> str:
    return f"""
        select m.key_id, m.date, m.mv, coalesce(c.cf, 0) cf,
               (m.mv-coalesce(c.cf, 0)) / nullif(lag(m.mv) over (partition by m.key_id order by m.date), 0)
               - 1 ret
        from (select g.key_id, g.date,
                     cast(sum(cast(h.shares as decimal(18,9))*cast(p.price as decimal(18,9))) as double) mv
              from (select d.key_id, d.date, f.fund_id
                    from (select distinct f.key_id, fp.value_date date
                          from (select key_id, fund_id, min(value_date) first_date from {{{day}}} group by all) f
                               join {{fund_price}} fp on f.fund_id=fp.fund_id and fp.value_date>=f.first_date) d
                         join (select key_id, fund_id, min(value_date) first_date from {{{day}}} group by all) f
                         on d.key_id=f.key_id and d.date>=f.first_date) g
                   asof join (select key_id, fund_id, value_date,
                                     sum(shares) over (partition by key_id, fund_id order by value_date) shares
                              from {{{day}}}) h
                        on g.key_id=h.key_id and g.fund_id=h.fund_id and g.date>=h.value_date
                   asof join {{fund_price}} p on g.fund_id=p.fund_id and g.date>=p.value_date
              group by g.key_id, g.date) m
             left join (select b.key_id, b.value_date,
                               cast(sum(cast(b.shares as decimal(18,9))*cast(p.price as decimal(18,9)))
                                    as double) cf
                        from {{{day}}} b join {{fund_price}} p
                             on b.fund_id=p.fund_id and b.value_date=p.value_date
                        group by all) c on m.key_id=c.key_id and m.date=c.value_date"""


VIEWS["portfolio_return"] = _returns("portfolio_day")
VIEWS["account_return"] = _returns("account_day")
VIEWS["expanding_return"] = """
    select p.name portfolio, a.date,
           (pow(product(1+b.ret), 252.0/count(*))-1)*100 ann_yield_pct
    from {portfolio_return} a join {portfolio_return} b on a.key_id=b.key_id and b.date<=a.date
         join {portfolio} p on p.id=a.key_id
    where a.ret is not null and b.ret is not null
    group by p.name, a.date having count(*)>=252"""
VIEWS["recent_return"] = """
    select e.portfolio, e.date, e.ann_yield_pct
    from {expanding_return} e
         join (select portfolio, max(date) recent from {expanding_return} group by portfolio) m
         on e.portfolio=m.portfolio and e.date=m.recent"""


def render(query: str, extra: dict[str, str]) -> str:
    """The query with all statements it needs in front, names resolved."""
    return fixtures.with_tables(query, {**VIEWS, **extra})
