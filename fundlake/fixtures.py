"""The data model derived from the given Parquet tables.

Every statement is written in the SQL common to Spark and DuckDB: ``tables()`` runs it in Spark and
``with_tables()`` puts the same text in front of an oracle query, so both sides start from equal rows.
Names in braces are other tables, either given ones or earlier statements.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from fundlake import schemas
from fundlake.sources.tables import Tables, read

AS_OF = "2001-08-01"
LOADED_AT = "2001-08-01 12:34:56"
FUND_PRICE_CUT = "2001-10-01"
RATE_VALUE_CUT = "2001-07-01"

_STAMP = f"cast('{LOADED_AT}' as timestamp)"
_DAY = "year({d})*10000+month({d})*100+day({d})"


def _day(column: str) -> str:
    return _DAY.replace("{d}", column)


STATEMENTS: dict[str, str] = {
    "currency": f"""
        select cast(r_regionkey as int) id,
               case r_regionkey when 0 then 'HUF' when 1 then 'CHF' when 2 then 'EUR'
                    when 3 then 'USD' else 'GBP' end iso_code,
               r_name description, {_STAMP} last_modification
        from {{region}}""",
    "account": f"""
        select c_custkey id, c_name account_name,
               case when c_mktsegment='BUILDING' then 'N' else 'Y' end tax_applicable,
               cast(15.0 as double) tax_rate_percent, n_regionkey currency_id,
               date '1995-01-01' + cast(c_custkey % 365 as int) date_open,
               c_mktsegment segment, {_STAMP} last_modification
        from {{customer}} join {{nation}} on c_nationkey=n_nationkey""",
    "fund": f"""
        select s_suppkey id, s_name fund_name,
               concat(case when s_suppkey % 2 = 0 then 'HU' else 'CH' end,
                      lpad(cast(s_suppkey as string),10,'0')) isin,
               n_regionkey currency_id, cast(s_suppkey as string) source_id,
               date '1995-01-01' inception_date,
               case when s_suppkey % 2 = 0 then 'Source A fund' else 'Source B fund' end description,
               {_STAMP} last_modification
        from {{supplier}} join {{nation}} on s_nationkey=n_nationkey
        union all
        select 999999999, 'Unpriced fund', 'HU9999999999', 0, 'x', date '1995-01-01',
               'Source A fund', {_STAMP}""",
    "fund_price": f"""
        select fund_id*100000000+{_day('value_date')} id, fund_id, value_date, price,
               {_STAMP} last_modification
        from (select l_suppkey fund_id, cast(l_shipdate as date) value_date,
                     min(l_extendedprice) price
              from {{lineitem}} group by l_suppkey, cast(l_shipdate as date)) p""",
    "fund_investment_transaction": f"""
        select cast(l_orderkey as bigint)*1000+l_linenumber*100+row_number() over (
                   partition by l_orderkey, l_linenumber
                   order by l_suppkey, l_partkey, l_shipdate, l_quantity, l_extendedprice) id,
               cast(l_shipdate as date) value_date, l_quantity share_amount,
               o_custkey account_id, l_suppkey fund_id, {_STAMP} last_modification
        from {{lineitem}} join {{orders}} on l_orderkey=o_orderkey""",
    "cash_transaction": """
        select o_orderkey id, o_custkey account_id,
               case when o_orderstatus='F' then o_totalprice else -o_totalprice end amount,
               cast(o_orderdate as date) value_date
        from {orders}""",
    "rate": f"""
        select 100+id id, concat(iso_code,'/HUF') rate_name, 'FX' rate_type, {_STAMP} last_modification
        from {{currency}} where id<>0
        union all
        select distinct 200+cast(substr(o_orderpriority,1,1) as int),
               concat('BASE ',substr(o_orderpriority,1,1)), 'interest', {_STAMP}
        from {{orders}}""",
    "rate_fx": """
        select 100+id id, id from_currency_id, 0 to_currency_id from {currency} where id<>0""",
    "rate_value": f"""
        select cast(rate_id as bigint)*100000000+{_day('value_date')} id, rate_id, value_date, value,
               {_STAMP} last_modification
        from (select 100+n_regionkey rate_id, cast(o_orderdate as date) + 92 value_date,
                     min(o_totalprice)/1000 value
              from {{orders}} join {{customer}} on o_custkey=c_custkey
                   join {{nation}} on c_nationkey=n_nationkey
              where n_regionkey<>0 group by n_regionkey, cast(o_orderdate as date)
              union all
              select 200+cast(substr(o_orderpriority,1,1) as int), cast(o_orderdate as date),
                     min(o_totalprice)/100000
              from {{orders}} group by o_orderpriority, cast(o_orderdate as date)) v""",
    "deposit": f"""
        select o_orderkey id, o_custkey account_id, cast(o_orderdate as date) value_date,
               cast(o_orderdate as date) + 90 maturity_date, o_totalprice amount,
               cast(1.5 as double) interest_rate,
               case when o_orderstatus='F' then 'fixed' else 'variable' end interest_rate_type,
               case when o_orderstatus<>'F' then cast(201 + o_orderkey % 6 as int) end reference_rate_id,
               cast(0.25 as double) interest_rate_spread, {_STAMP} last_modification
        from {{orders}}""",
    "portfolio_x_account_rltnp": """
        select case segment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3
                    when 'HOUSEHOLD' then 4 else 5 end portfolio_id, id account_id
        from {account}
        union all
        select 10+currency_id, id from {account}""",
    "portfolio": """
        select distinct portfolio_id id, concat('Portfolio ',cast(portfolio_id as string)) name,
               case when portfolio_id<10 then 'by segment' else 'by region' end description,
               cast(null as date) last_valuation_date
        from {portfolio_x_account_rltnp}""",
    "yield_curve": """
        select 0 currency_id,
               cast(case substr(o_orderpriority,1,1) when '1' then 90 when '2' then 365
                    when '3' then 1095 when '4' then 1825 else 3650 end as double) tenor,
               'Benchmark' type, cast(o_orderdate as date) value_date,
               min(o_totalprice)/100000 yield
        from {orders} group by o_orderpriority, cast(o_orderdate as date)""",
    "ld_fund_price": """
        select cast(value_date as string) date, cast(fund_id as string) fund_id,
               concat('f',cast(fund_id as string)) fund_name, cast(price as string) price
        from {fund_price} where value_date >= date '2001-09-01'""",
    "ld_rate_value": """
        select cast(value_date as string) value_date, cast(value as string) value,
               concat('BASE ',cast(rate_id-200 as string)) rate_name
        from {rate_value} where rate_id>200 and value_date >= date '2001-06-01'""",
    "ld_yield_curve": """
        select cast(value_date as string) date, cast(tenor as string) tenor,
               cast(yield as string) yield, type, cast(currency_id as string) currency_id
        from {yield_curve} where value_date >= date '2001-06-01'""",
}

_NAME = re.compile(r"\{(\w+)\}")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The data model over the Parquet files of ``sf_dir``; nothing is read before an action."""
    given = Tables(
        list(schemas.SOURCE),
        lambda name: read(spark, name, sf_dir, schemas.SOURCE[name], suffix=".parquet"),
    )
    everything: Tables

    def open_table(name: str) -> DataFrame:
        return derive(everything, STATEMENTS[name]) if name in STATEMENTS else given[name]

    everything = Tables([*STATEMENTS, *given], open_table)
    return everything


def derive(t: Tables, statement: str) -> DataFrame:
    """Result of a statement in the common SQL; table names stand in braces."""
    inputs = {name: t[name] for name in sorted(set(_NAME.findall(statement)))}
    return next(iter(inputs.values())).sparkSession.sql(statement, **inputs)


def with_tables(query: str, views: Mapping[str, str] | None = None) -> str:
    """``query`` preceded by the common table expressions it needs; table names stand in braces."""
    statements = {**STATEMENTS, **(views or {})}
    needed: list[str] = []

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text).strip()

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in statements and name not in needed:
                visit(statements[name])
                needed.append(name)

    visit(query)
    if not needed:
        return plain(query)
    parts = ",\n".join(f"{name} as ({plain(statements[name])})" for name in needed)
    return f"with {parts}\n{plain(query)}"
