"""Selectors, review tables, paging, display formats and entry of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake import fixtures, schemas
from fundlake.catalog import Entry, on_tables
from fundlake.operators import records
from fundlake.operators.paging import rows_in_order
from fundlake.plans import review, views
from fundlake.sources.tables import Tables, append, read, scratch

# Entered records in the common SQL, some of them wrong.
RECORDS = {
    "new_account": """
        select concat('New ', account_name) account_name,
               case when id % 10 = 3 then '' else tax_applicable end tax_applicable,
               case when id % 10 = 4 then 'abc' else '15.0' end tax_rate_percent,
               case when id % 10 = 5 then '99' else cast(currency_id as string) end currency_id,
               case when id % 10 = 6 then 'soon' else cast(date_open as string) end date_open
        from {account}""",
    "new_deposit": """
        select cast(case when id % 10 = 3 then -account_id else account_id end as string) account_id,
               cast(value_date as string) value_date,
               case when id % 10 = 4 then '' else '1000.5' end amount,
               cast(maturity_date as string) maturity_date,
               case when id % 3 = 0 then '' else '1.5' end interest_rate, interest_rate_type,
               case when reference_rate_id is null then '' else cast(reference_rate_id as string) end
               reference_rate_id,
               case when id % 3 = 1 then '' when id % 10 = 5 then '1,5' else '0.25' end interest_rate_spread
        from {deposit}""",
    "new_fund": """
        select concat('New ', fund_name) fund_name, isin,
               case when id % 10 = 3 then '99' when id % 10 = 4 then 'HUF'
                    else cast(currency_id as string) end currency_id,
               source_id,
               case when id % 10 = 5 then '1995-13-01' else cast(inception_date as string) end inception_date,
               case when id % 10 = 6 then null else description end description
        from {fund}""",
    "new_rate": """
        select concat('New ', rate_name) rate_name,
               case when id % 4 = 1 then 'bond' else rate_type end rate_type
        from {rate}""",
    "new_currency": """
        select case when id = 2 then null else concat('X', iso_code) end iso_code, description
        from {currency}""",
    "new_investment": """
        select case when id % 10 = 3 then '' else cast(value_date as string) end value_date,
               case when id % 10 = 4 then 'ten' else cast(share_amount as string) end share_amount,
               cast(case when id % 10 = 5 then -account_id else account_id end as string) account_id,
               cast(case when id % 10 = 6 then -fund_id else fund_id end as string) fund_id
        from {fund_investment_transaction}""",
}


#: The stored table of each form.
TABLES = {"new_account": "account", "new_deposit": "deposit", "new_fund": "fund", "new_rate": "rate", "new_currency": "currency",
          "new_investment": "fund_investment_transaction"}


def _text(name: str, kind: str) -> Column:
    """A stored value as text."""
    return (F.col(name).cast("decimal(28,6)") if kind == "double" else F.col(name)).cast("string").alias(name)


def _sql_text(name: str, kind: str) -> str:
    typed = name if kind == "string" else f"try_cast({name} as {kind})"
    return f"cast({f'cast({typed} as decimal(28,6))' if kind == 'double' else typed} as varchar)"


def _entry(form: str, add, sql: str) -> Entry:
    """Records entered into a stored copy of their table: the whole table read back, and the rejected rows as entered."""
    table = TABLES[form]
    target = schemas.MODEL[table]
    kinds = {f.name: f.dataType.simpleString() for f in target.fields if f.name not in ("id", "last_modification")}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, folder = fixtures.tables(spark, sf_dir), scratch(spark, "entry")
        append(t[table].select(*target.fieldNames()), table, folder)
        last = read(spark, table, folder).agg(F.max("id")).first()[0]
        entered = add(fixtures.derive(t, RECORDS[form]), t)
        records.append_records(entered, table, folder, fixtures.LOADED_AT)
        state = F.when(F.col("id") <= F.lit(last), "stored").otherwise("accepted").alias("state")
        back = read(spark, table, folder).select(*[_text(c, k) for c, k in kinds.items()], state, F.lit(None).cast("string").alias("reason"))
        return back.unionByName(entered.rejected.withColumn("state", F.lit("rejected")))

    shown = ", ".join(f"case when reason is null then {_sql_text(c, k)} else {c} end {c}" for c, k in kinds.items())
    plain = ", ".join(f"{_sql_text(c, k)} {c}" for c, k in kinds.items())
    return Entry(run, f"""select {shown}, case when reason is null then 'accepted' else 'rejected' end state, reason
        from ({sql}) entered
        union all
        select {plain}, 'stored', null from {{{table}}}""")


def _unknown(table: str, key: str, kind: str) -> str:
    return (f"when {key}<>'' and try_cast({key} as {kind}) not in (select id from {{{table}}})"
            f" then '{key} is unknown'")


_STAMP = "strftime(last_modification,'%Y-%m-%d %H:%M:%S') \"LastModification\""


def _page(t: Tables) -> DataFrame:
    prices = review.review_fund_prices(t.fund_price)
    return review.table_page(prices, ["-FundPrice", "PriceID"], page=2, search="-07")


def _deep_page(t: Tables) -> DataFrame:
    """Rows 3001 to 3010 of all purchases, of which one range is sorted."""
    lots = t.fund_investment_transaction.select("id", "value_date", "share_amount", "account_id", "fund_id")
    return rows_in_order(lots, ["-value_date", "share_amount", "id"], 3000, 10, sort_rows=500)


def _formats(t: Tables) -> DataFrame:
    lots = views.investment_lots(t).select(
        "account_id", "fund_id", "value_date", "share_amount", F.col("tr_value").alias("cost"),
        (F.col("share_amount") / 100).alias("share"),
    )
    return review.format_percent_and_thousands(lots, ["share"], ["cost"])


def _selector(label: str, table: str) -> str:
    return (f"select '' id, 'please select..' \"label\" union all"
            f" select cast(id as varchar), {label} from {{{table}}}")


ENTRIES: dict[str, Entry] = {
    "selector_currency": Entry(on_tables(review.selector_currency), _selector("iso_code", "currency")),
    "selector_account": Entry(on_tables(review.selector_account), _selector("account_name", "account")),
    "selector_interest_rate": Entry(
        on_tables(review.selector_interest_rate), _selector("rate_name", "rate") + " where rate_type='interest'"),
    "selector_fund": Entry(on_tables(review.selector_fund), _selector("fund_name", "fund")),
    "review_accounts": Entry(
        on_tables(lambda t: review.review_accounts(t.account)),
        'select id "AccountID", account_name "AccountName", tax_applicable "TaxApplicable",'
        ' tax_rate_percent "TaxRatePercentage", currency_id "CurrencyID", date_open "OpeningDate",'
        f" {_STAMP} from {{account}}",
    ),
    "review_deposits": Entry(
        on_tables(lambda t: review.review_deposits(t.deposit)),
        'select id "DepositID", account_id "AccountID", value_date "ValueDate",'
        ' maturity_date "MaturityDate", amount "Amount", interest_rate "IntRate",'
        ' interest_rate_type "IntRateType", reference_rate_id "RateID",'
        f' interest_rate_spread "IntSpread", {_STAMP} from {{deposit}}',
    ),
    "review_funds": Entry(
        on_tables(lambda t: review.review_funds(t.fund)),
        'select id "FundID", fund_name "FundName", isin "ISIN", currency_id "CurrencyID",'
        ' source_id "SourceID", description "Description",'
        f" strftime(inception_date,'%Y-%m-%d') \"InceptionDate\", {_STAMP} from {{fund}} order by id",
    ),
    "review_fund_prices": Entry(
        on_tables(lambda t: review.review_fund_prices(t.fund_price)),
        'select id "PriceID", value_date "ValueDate", fund_id "FundID", price "FundPrice",'
        f" {_STAMP} from {{fund_price}} order by last_modification desc, value_date desc, fund_id",
    ),
    "review_rates": Entry(
        on_tables(lambda t: review.review_rates(t.rate)),
        f'select id "RateID", rate_name "RateName", rate_type "RateType", {_STAMP} from {{rate}}',
    ),
    "review_rate_values": Entry(
        on_tables(lambda t: review.review_rate_values(t.rate_value)),
        'select id "RateValueID", rate_id "RateID", value_date "ValueDate", value "Value",'
        f" {_STAMP} from {{rate_value}} order by value_date desc, rate_id",
    ),
    "review_currencies": Entry(
        on_tables(lambda t: review.review_currencies(t.currency)),
        f'select id "CurrencyID", iso_code "ISO", description "Description", {_STAMP}'
        " from {currency} order by id",
    ),
    "review_investments": Entry(
        on_tables(lambda t: review.review_investments(t.fund_investment_transaction)),
        "select id \"TransactionID\", strftime(value_date,'%Y-%m-%d') \"ValueDate\","
        f' share_amount "ShareAmount", account_id "AccountID", fund_id "FundID", {_STAMP}'
        " from {fund_investment_transaction} order by value_date desc",
    ),
    "table_page": Entry(
        on_tables(_page),
        f"""select id "PriceID", value_date "ValueDate", fund_id "FundID", price "FundPrice", {_STAMP}
        from {{fund_price}}
        where cast(id as varchar) like '%-07%' or cast(value_date as varchar) like '%-07%'
              or cast(fund_id as varchar) like '%-07%' or cast(price as varchar) like '%-07%'
              or strftime(last_modification,'%Y-%m-%d %H:%M:%S') like '%-07%'
        order by price desc, id limit 10 offset 10""",
    ),
    "table_page_deep": Entry(
        on_tables(_deep_page),
        """select id, value_date, share_amount, account_id, fund_id from {fund_investment_transaction}
        order by value_date desc, share_amount, id limit 10 offset 3000""",
    ),
    "format_percent_and_thousands": Entry(
        on_tables(_formats),
        """select account_id, fund_id, value_date, share_amount,
               replace(format('{:,.0f}', tr_value), ',', ' ') cost,
               format('{:.2f}%', share_amount/100*100) share
        from {lot_vw}""",
    ),
    "add_account": _entry(
        "new_account", records.add_account,
        f"""select *, case when tax_applicable not in ('Y','N') then 'tax_applicable must be Y or N'
               when try_cast(tax_rate_percent as double) is null then 'tax_rate_percent is no number'
               when try_cast(date_open as date) is null then 'date_open is no date'
               {_unknown('currency', 'currency_id', 'int')} end reason from {{new_account}}""",
    ),
    "add_deposit": _entry(
        "new_deposit", records.add_deposit,
        f"""select account_id, value_date, amount, maturity_date, interest_rate_type,
               case when reason is null and interest_rate='' then '0.0' else interest_rate end interest_rate,
               case when reason is null and reference_rate_id='' then null else reference_rate_id end
               reference_rate_id,
               case when reason is null and interest_rate_spread='' then '0.0' else interest_rate_spread end
               interest_rate_spread, reason
        from (select *, case when try_cast(amount as double) is null then 'amount is no number'
                     when interest_rate_spread<>'' and try_cast(interest_rate_spread as double) is null
                     then 'interest_rate_spread is no number'
                     {_unknown('account', 'account_id', 'bigint')}
                     {_unknown('rate', 'reference_rate_id', 'int')} end reason from {{new_deposit}}) d""",
    ),
    "add_fund": _entry(
        "new_fund", records.add_fund,
        f"""select *, case when try_cast(currency_id as int) is null then 'currency_id is no key'
               when try_cast(inception_date as date) is null then 'inception_date is no date'
               when description is null then 'description is missing'
               {_unknown('currency', 'currency_id', 'int')} end reason from {{new_fund}}""",
    ),
    "add_rate": _entry(
        "new_rate", lambda rows, t: records.add_rate(rows),
        "select *, case when rate_type not in ('interest','FX') then 'rate_type must be interest or FX' end"
        " reason from {new_rate}",
    ),
    "add_currency": _entry(
        "new_currency", lambda rows, t: records.add_currency(rows),
        "select *, case when iso_code is null then 'iso_code is missing' end reason from {new_currency}",
    ),
    "add_investment": _entry(
        "new_investment", records.add_investment,
        f"""select *, case when try_cast(value_date as date) is null then 'value_date is no date'
               when try_cast(share_amount as double) is null then 'share_amount is no number'
               {_unknown('account', 'account_id', 'bigint')}
               {_unknown('fund', 'fund_id', 'bigint')} end reason from {{new_investment}}""",
    ),
}
