"""Sources, cleansing, control tables and loads.

Raw text (pages, sheets, staged rows) is rendered from the stored tables with a few bad cells; the oracle
gives the typed originals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake import fixtures, schemas
from fundlake.catalog import Entry, analytics, on_tables, rounded
from fundlake.functions import cleaning
from fundlake.operators import loads
from fundlake.plans import jobs, refresh
from fundlake.sources import html, monthly, positional, requests, tables
from fundlake.sources.tables import Tables
from fundlake.streaming.ingest import stream_ingest

# A cell is spoilt on one day of the month, a second one on another.
BAD_DAY, OTHER_BAD_DAY = 13, 7

# Common SQL of staged rows that have no table in the fixture mapping.
STAGED = {
    "ld_fx": """
        select cast(v.value_date as string) value_date, cast(v.value as string) value,
               case when v.rate_id=104 then 'XXX' else c.iso_code end rate_name
        from {rate_value} v join {rate_fx} x on v.rate_id=x.id join {currency} c on c.id=x.from_currency_id
        where v.value_date >= date '2001-06-01'""",
    "ld_interest": """
        select value_date, value, case when rate_name='BASE 5' then 'BASE ?' else rate_name end rate_name
        from {ld_rate_value}""",
}


def _spoilt(date: str, day: int, text: Column, bad: str) -> Column:
    return F.when(F.dayofmonth(date) == day, F.lit(bad)).otherwise(text)


def _good(date: str, day: int, column: str) -> str:
    return f"case when day({date})={day} then null else {column} end"


def _fx_text(t: Tables, suffix: str) -> DataFrame:
    """Fetched rate rows: long date text, value text, the currency they were fetched for."""
    currency = t.currency.select(F.col("id").alias("from_currency_id"), "iso_code")
    pair = t.rate_fx.select(F.col("id").alias("rate_id"), "from_currency_id").join(currency, "from_currency_id")
    return t.rate_value.join(pair, "rate_id").select(
        _spoilt("value_date", BAD_DAY, F.date_format("value_date", "d MMMM yyyy"), "n/a").alias("c1"),
        _spoilt("value_date", OTHER_BAD_DAY, F.concat(F.col("value").cast("string"), F.lit(suffix)), "-")
        .alias("c2"),
        "iso_code",
    )


_FX_TYPED = f"""
    select {_good('v.value_date', BAD_DAY, 'v.value_date')} value_date,
           {_good('v.value_date', OTHER_BAD_DAY, 'v.value')} value, c.iso_code rate_name
    from {{rate_value}} v join {{rate_fx}} x on v.rate_id=x.id
         join {{currency}} c on c.id=x.from_currency_id"""


def _fund_prices(t: Tables) -> DataFrame:
    name = t.fund.select(F.col("id").alias("fund_id"), "fund_name")
    return t.fund_price.select("fund_id", "value_date", "price").join(name, "fund_id")


def _fund_text(t: Tables) -> DataFrame:
    """Fetched fund rows: dotted date, price, net asset value with thousands commas, dividend."""
    return _fund_prices(t).select(
        "fund_id",
        "fund_name",
        "value_date",
        F.date_format("value_date", "yyyy.MM.dd.").alias("date"),
        _spoilt("value_date", BAD_DAY, F.col("price").cast("string"), "n/a").alias("price"),
        F.format_number(F.col("price") * 1000, 2).alias("net_asset_value"),
        F.lit("0").alias("paid_dividend"),
    )


def _tag(name: str, *inner: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(i) if isinstance(i, str) else i for i in inner], F.lit(f"</{name}>"))


def _pages(rows: DataFrame, keys: list[str], cells: list[str], before: str, after: str) -> DataFrame:
    """One HTML page per fund and year; a page has at most one row per day of the year."""
    line = _tag("tr", *[_tag("td", F.lit(" "), F.col(c), F.lit("&nbsp;")) for c in cells])
    lines = F.sort_array(F.collect_list(F.struct("value_date", line.alias("line"))))
    return rows.groupBy(*keys, F.year("value_date").alias("year")).agg(
        F.concat(F.lit(before), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit(after))
        .alias("html")
    )


def _seventh_table_pages(t: Tables) -> DataFrame:
    other = "<table><tr><td>menu</td></tr></table>"
    head = "<tr><th>Date</th><th>Price</th><th>Net asset value</th><th>Dividend</th></tr>"
    return _pages(
        _fund_text(t), ["fund_id", "fund_name"], ["date", "price", "net_asset_value", "paid_dividend"],
        f"<html><body>{other * 6}<table border=\"1\">{head}", "</table></body></html>",
    )


def _titled_pages(t: Tables) -> DataFrame:
    rows = _fund_prices(t).select(
        "fund_id", "fund_name", "value_date",
        F.lit("CHF").alias("ccy"), F.date_format("value_date", "dd.MM.yyyy").alias("day"),
        F.col("price").cast("string").alias("nav"),
    )
    captions = "".join(f"<tr><td>caption {i}</td></tr>" for i in range(5))
    titles = "<tr><td>Currency</td><td><b>NAV Date</b></td><td>NAV</td></tr>"
    return _pages(rows, ["fund_id", "fund_name"], ["ccy", "day", "nav"],
                  f"<table>{captions}{titles}", "</table>")


_FUND_CELLS = ["date", "price", "net_asset_value", "paid_dividend"]


def _fund_page_rows(t: Tables) -> DataFrame:
    return html.extract_html_table(_seventh_table_pages(t), 7, ["fund_id", "fund_name", "year"], _FUND_CELLS)


def _curve_sheet(t: Tables) -> DataFrame:
    """Four columns under source titles; the third one is empty on the bad day."""
    return t.yield_curve.select(
        F.col("value_date").alias("Settle date"), F.col("tenor").alias("Days"),
        F.when(F.dayofmonth("value_date") != BAD_DAY, F.lit("ok")).alias("Note"),
        F.col("yield").alias("Yield (%)"),
    )


def _benchmark_sheet(t: Tables) -> DataFrame:
    """Twelve columns: the date in 2, the tenor code in 3, the yield in 7."""
    code = (F.when(F.col("tenor") == 90, "M3").when(F.col("tenor") == 365, "M12")
            .when(F.col("tenor") == 1095, "Y3").when(F.col("tenor") == 1825, "Y5").otherwise("other"))
    filler = [F.lit(i).alias(f"x{i}") for i in range(9)]
    return t.yield_curve.select(
        filler[0], F.col("value_date"), code.alias("code"), *filler[1:4], F.col("yield"), *filler[4:]
    )


def _index_sheet(t: Tables) -> DataFrame:
    """Six columns: date, name and value in 2, 3 and 6; no value on the bad day."""
    name = t.rate.select(F.col("id").alias("rate_id"), "rate_name")
    return t.rate_value.join(name, "rate_id").select(
        F.lit(1).alias("a"), F.col("value_date").alias("b"), F.col("rate_name").alias("c"),
        F.lit(4).alias("d"), F.lit(5).alias("e"),
        F.when(F.dayofmonth("value_date") != BAD_DAY, F.col("value")).alias("f"),
    )


def _positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tables.scratch(spark, "sheet")
    _curve_sheet(fixtures.tables(spark, sf_dir)).write.option("header", "true").csv(folder)
    rows = positional.read_positional(spark, folder, [1, 2, 4], [1, 2, 3, 4], ["date", "tenor", "yield"])
    return rows.select("date", F.col("tenor").cast("double"), F.col("yield").cast("double"))


_PRICE = ["fund_id", "value_date", "price"]


def _old_prices(t: Tables) -> DataFrame:
    return t.fund_price.filter(F.col("value_date") < fixtures.FUND_PRICE_CUT)


def _old_rates(t: Tables) -> DataFrame:
    return t.rate_value.filter(F.col("value_date") < fixtures.RATE_VALUE_CUT)


def _old_curve(t: Tables) -> DataFrame:
    return t.yield_curve.filter(F.col("value_date") < fixtures.RATE_VALUE_CUT)


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored prices up to the cut, then the staged rows appended; the table read back."""
    t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "append")
    tables.append(_old_prices(t).select(*_PRICE), "fund_price", folder, schemas.PRICE_ROW)
    stored = tables.read(spark, "fund_price", folder, schemas.PRICE_ROW)
    tables.append(loads.load_fund_price_dedup(t.ld_fund_price, stored), "fund_price", folder, schemas.PRICE_ROW)
    return tables.read(spark, "fund_price", folder, schemas.PRICE_ROW)


def _stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches staged one after the other; the table holds the second."""
    t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "stage")
    tables.stage(t.ld_rate_value, "ld_rate_value", folder)
    tables.stage(fixtures.derive(t, STAGED["ld_interest"]), "ld_rate_value", folder)
    return tables.read(spark, "ld_rate_value", folder)


def _requests(t: Tables) -> DataFrame:
    """Requests of all four fetching jobs."""
    plans = [
        (loads.control_fx(t), requests.FX_URL, requests.ISO_DATE),
        (loads.control_interest(t), requests.INTEREST_URL, requests.SLASHED_DATE),
        (loads.control_funds(t, loads.isin_in_country("HU")), requests.FUND_BY_ISIN_URL, requests.ISO_DATE),
        (loads.control_funds(t, loads.described_as("Source B")), requests.FUND_HISTORY_URL, requests.ISO_DATE),
    ]
    urls = [requests.plan_requests(control, url, fixtures.AS_OF, fmt).select("url")
            for control, url, fmt in plans]
    return urls[0].unionByName(urls[1]).unionByName(urls[2]).unionByName(urls[3])


def _known_batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Fetched and stored prices; the date is missing on the bad day in both."""
    dated = F.when(F.dayofmonth("value_date") != BAD_DAY, F.col("value_date"))
    batch = t.fund_price.filter(F.col("value_date") >= "2001-09-01").select(
        "fund_id", dated.alias("date"), "price")
    return batch, _old_prices(t).select("fund_id", dated.alias("value_date"))


def _rate_pages(t: Tables, names: DataFrame, key: str, suffix: str) -> DataFrame:
    """Pages of rate rows (long date, value) for each name, one per year."""
    rows = t.rate_value.join(names, "rate_id").select(
        key, "value_date",
        _spoilt("value_date", BAD_DAY, F.date_format("value_date", "d MMMM yyyy"), "n/a").alias("date"),
        _spoilt("value_date", OTHER_BAD_DAY, F.concat(F.col("value").cast("string"), F.lit(suffix)), "-").alias("value"))
    return _pages(rows, [key], ["date", "value"], "<table>", "</table>").drop("year")


def _fx_pages(t: Tables) -> DataFrame:
    currency = t.currency.select(F.col("id").alias("from_currency_id"), "iso_code")
    names = t.rate_fx.select(F.col("id").alias("rate_id"), "from_currency_id").join(currency, "from_currency_id")
    return _rate_pages(t, names, "iso_code", "")


def _interest_pages(t: Tables) -> DataFrame:
    names = t.rate.filter(F.col("rate_type") == "interest").select(F.col("id").alias("rate_id"), "rate_name")
    return _rate_pages(t, names, "rate_name", "%")


def _curve_before(t: Tables, curve: str) -> Tables:
    """The stored curve up to the cut, as points of the given curve."""
    return t.replace(yield_curve=_old_curve(t).withColumn("type", F.lit(curve)))


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored views, refreshed whole and once more without anything new; their rows, counted."""
    t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "views")
    refresh.refresh_views(spark, folder, t)
    stored = refresh.refresh_views(spark, folder, t, {})
    counts = [stored.read(name, t).agg(F.count("*").alias("rows")).select(F.lit(name).alias("view"), "rows") for name in refresh.VIEWS]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# Days at which the refreshes of the incremental queries end; rows of some earlier days come in late.
_REFRESHED = ("2001-09-15", "2001-10-20", "9999-12-31")


def _late(t: Tables) -> dict[str, Column]:
    """Which rows come in late, by table."""
    return {
        "fund_price": (F.dayofmonth("value_date") == BAD_DAY) & (F.col("value_date") >= "2001-07-01"),
        "fund_investment_transaction": (F.col("id") % 97 == 0) & (F.col("value_date") >= "2001-05-01"),
        "yield_curve": F.dayofmonth("value_date") == BAD_DAY,
        "rate_value": F.dayofmonth("value_date") == BAD_DAY,
    }


def _refreshed(view: str, needs: list[str]):
    """The view after a whole refresh, one that also meets late rows, and one more."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "views")
        late = _late(t)
        until = {day: {n: t[n].filter(F.col("value_date") < day) for n in needs} for day in _REFRESHED}
        first, second, third = (until[day] for day in _REFRESHED)
        stored = refresh.StoredViews(spark, folder)
        stored.refresh(view, t.replace(**{n: df.filter(~late[n]) for n, df in first.items()}))
        new = {n: second[n].filter(late[n] | (F.col("value_date") >= _REFRESHED[0])) for n in needs}
        stored.refresh(view, t.replace(**second), new)
        stored.refresh(view, t.replace(**third), {n: df.filter(F.col("value_date") >= _REFRESHED[1]) for n, df in third.items()})
        return stored.read(view, t)

    return run


def _refreshed_returns(view: str):
    run = _refreshed(view, ["fund_price", "fund_investment_transaction"])
    return lambda spark, sf_dir: rounded(rounded(run(spark, sf_dir), "return"), "market_value", "cash_flow", digits=2)


def _refreshed_valuation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation dates from the state of the returns, after a whole refresh and a later one."""
    t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "views")
    stored = refresh.StoredViews(spark, folder)
    stored.refresh("portfolio_returns", t.replace(fund_price=_old_prices(t)))
    stored.refresh("portfolio_returns", t, {})
    return stored.valuation_dates(t)


_PRICE_KEY = ["fund_id", "value_date"]


def _streamed(spark: SparkSession, folder: str, landed, parse, files: int) -> DataFrame:
    """All landed files ingested, twice; the table after that."""
    for _ in range(2):
        stream_ingest(spark, f"{folder}/landing", landed, parse, _PRICE_KEY, "fund_price", folder, schemas.PRICE_ROW,
                      f"{folder}/checkpoint", files_per_batch=files)
    return monthly.read(spark, "fund_price", folder, schemas.PRICE_ROW).drop(monthly.MONTH)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged prices land as files next to an earlier load and are ingested."""
    t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "stream")
    monthly.write(_old_prices(t).select(*_PRICE), "fund_price", folder, "first", schema=schemas.PRICE_ROW)
    t.ld_fund_price.repartition(3).write.parquet(f"{folder}/landing")
    return _streamed(spark, folder, schemas.MODEL["ld_fund_price"], loads.typed_fund_prices, 2)


def _stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages land as files, some of them twice, and are cut into price rows as they are ingested."""
    t, folder = fixtures.tables(spark, sf_dir), tables.scratch(spark, "stream")
    pages = _seventh_table_pages(t).drop("year")
    again = pages.filter(F.pmod(F.hash("fund_id"), F.lit(10)) == 0)
    pages.unionByName(again).repartition(4).write.parquet(f"{folder}/landing")
    return _streamed(spark, folder, pages.schema, lambda rows: loads.typed_fund_prices(jobs.fetched_fund_prices(rows)), 2)


_ANTI_RATE = f"(select * from {{rate_value}} where value_date < date '{fixtures.RATE_VALUE_CUT}')"
_ANTI_CURVE = f"(select * from {{yield_curve}} where value_date < date '{fixtures.RATE_VALUE_CUT}')"
_ANTI_PRICE = f"(select * from {{fund_price}} where value_date < date '{fixtures.FUND_PRICE_CUT}')"
_LAST_PRICE = "(select fund_id, max(value_date) value_date from {fund_price} group by fund_id)"
_FUND_CONTROL = f"""select f.id fund_id, f.isin, f.fund_name, f.source_id,
    coalesce(fpv.value_date, f.inception_date-1)+1 import_date_from
    from {{fund}} f left join {_LAST_PRICE} fpv on f.id=fpv.fund_id"""
_FX_CONTROL = """select iso_code, id, last_fx_rate_value+1 import_date, date_open_min, last_fx_rate_value
    from (select p.id,
                 (select iso_code from {currency} where id=p.from_currency_id) iso_code,
                 (select min(date_open) from {account} where currency_id=p.from_currency_id) date_open_min,
                 (select max(value_date) from {rate_value} where rate_id=p.id) last_fx_rate_value
          from {rate_fx} p where p.to_currency_id in (select id from {currency} where iso_code='HUF')) pair
    where iso_code not in ('HUF') and date_open_min is not null and last_fx_rate_value is not null"""
_INTEREST_CONTROL = """select id, rate_name, date_open, coalesce(last_day+1, date_open) import_date
    from (select r.id, r.rate_name,
                 (select min(value_date) from {deposit} d where d.reference_rate_id=r.id) date_open,
                 (select max(value_date) from {rate_value} v where v.rate_id=r.id) last_day
          from {rate} r where r.rate_type='interest') k
    where date_open is not null"""
_FUND_ROW = f"{_good('p.value_date', BAD_DAY, 'p.price')} price"

ENTRIES: dict[str, Entry] = {
    "table_scan": Entry(
        lambda spark, sf_dir: tables.read(
            spark, "orders", sf_dir, schemas.SOURCE["orders"], suffix=".parquet"
        ).withColumn("o_orderdate", F.to_date("o_orderdate")),
        "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) o_orderdate,"
        " o_orderpriority from orders",
    ),
    "table_append": Entry(_append, "select fund_id, value_date, price from {fund_price}"),
    "stage_replace": Entry(_stage, "select value_date, value, rate_name from {ld_interest}"),
    "html_table_extract": Entry(
        on_tables(_fund_page_rows),
        f"""select fund_id, fund_name, "year", row_no, date, price, net_asset_value, paid_dividend
        from (select p.fund_id, f.fund_name, cast(year(p.value_date) as int) as "year",
                     cast(1+row_number() over (partition by p.fund_id, year(p.value_date) order by p.value_date)
                          as int) row_no,
                     strftime(p.value_date,'%Y.%m.%d.') date,
                     case when day(p.value_date)={BAD_DAY} then 'n/a' else cast(p.price as varchar) end price,
                     format('{{:,.2f}}', p.price*1000) net_asset_value, '0' paid_dividend
              from {{fund_price}} p join {{fund}} f on p.fund_id=f.id
              union all
              select distinct p.fund_id, f.fund_name, cast(year(p.value_date) as int), 1, 'Date', 'Price',
                     'Net asset value', 'Dividend'
              from {{fund_price}} p join {{fund}} f on p.fund_id=f.id) r""",
    ),
    "delimited_positional": Entry(
        _positional,
        f"select cast(value_date as varchar) date, tenor, yield from {{yield_curve}} where day(value_date)<>{BAD_DAY}",
    ),
    "request_plan": Entry(
        on_tables(_requests),
        f"""select 'https://www.mnb.hu/en/arfolyam-tablazat?deviza=rbCurrencySelect&devizaSelected='||iso_code
               ||'&datefrom='||import_date||'&datetill={fixtures.AS_OF}&order=1' url from ({_FX_CONTROL}) a
        union all
        select 'https://www.mnb.hu/en/Jegybanki_alapkamat_alakulasa?datefrom='
               ||strftime(import_date,'%d%%2F%m%%2F%Y')||'&datetill=01%2F08%2F2001&order=0'
        from ({_INTEREST_CONTROL}) b
        union all
        select 'http://www.bamosz.hu/en/alapoldal?isin='||isin from {{fund}} where isin like 'HU%'
        union all
        select 'https://amfunds.credit-suisse.com/ch/en/retail/fund/history/'||isin||'?currency=CHF'
        from {{fund}} where description like 'Source B%'""",
    ),
    "clean_fx_rows": Entry(
        on_tables(lambda t: cleaning.clean_fx_rows(_fx_text(t, ""), "c1", "c2", "iso_code")), _FX_TYPED),
    "clean_ir_rows": Entry(
        on_tables(lambda t: cleaning.clean_ir_rows(_fx_text(t, "%"), "c1", "c2", "iso_code")), _FX_TYPED),
    "clean_fund_price_rows": Entry(
        on_tables(lambda t: cleaning.clean_fund_price_rows(_fund_page_rows(t).filter(F.col("row_no") > 1))),
        f"select p.value_date date, p.fund_id, f.fund_name, {_FUND_ROW}"
        " from {fund_price} p join {fund} f on p.fund_id=f.id",
    ),
    "clean_cs_price_rows": Entry(
        on_tables(lambda t: cleaning.clean_cs_price_rows(html.extract_titled_table(
            _titled_pages(t), 1, ["fund_id", "fund_name"], 6, ["NAV Date", "NAV"]))),
        "select p.value_date date, p.fund_id, f.fund_name, cast(p.price as varchar) price"
        " from {fund_price} p join {fund} f on p.fund_id=f.id",
    ),
    "clean_yield_curve": Entry(
        on_tables(lambda t: cleaning.clean_yield_curve(_curve_sheet(t), t.currency)),
        f"""select value_date date, tenor, yield, 'HUF Zero Coupon' "type",
               (select id from {{currency}} where iso_code='HUF') currency_id
        from {{yield_curve}} where day(value_date)<>{BAD_DAY}""",
    ),
    "tenor_code_to_days": Entry(
        on_tables(lambda t: cleaning.tenor_code_to_days(_benchmark_sheet(t), t.currency)),
        """select value_date date, case when tenor=3650 then null else cast(tenor as int) end tenor, yield,
               'HUF Benchmark Rates' "type", (select id from {currency} where iso_code='HUF') currency_id
        from {yield_curve}""",
    ),
    "clean_index_rows": Entry(
        on_tables(lambda t: cleaning.clean_index_rows(_index_sheet(t))),
        f"select v.value_date, v.value, r.rate_name from {{rate_value}} v join {{rate}} r on v.rate_id=r.id"
        f" where day(v.value_date)<>{BAD_DAY}",
    ),
    "ctl_fx": Entry(on_tables(loads.control_fx), _FX_CONTROL),
    "ctl_interest": Entry(on_tables(loads.control_interest), _INTEREST_CONTROL),
    "ctl_fund_by_isin": Entry(
        on_tables(lambda t: loads.control_funds(t, loads.isin_in_country("HU"))),
        f"{_FUND_CONTROL} where f.isin like 'HU%'",
    ),
    "ctl_fund_by_desc": Entry(
        on_tables(lambda t: loads.control_funds(t, loads.described_as("Source A"))),
        f"{_FUND_CONTROL} where f.description like 'Source A%'",
    ),
    "load_fx": Entry(
        on_tables(lambda t: loads.load_fx(fixtures.derive(t, STAGED["ld_fx"]), t)),
        """select rfx.id rate_id, cast(l.value_date as date) value_date, cast(l.value as double) value
        from {ld_fx} l join {currency} c on l.rate_name=c.iso_code
             join {rate_fx} rfx on c.id=rfx.from_currency_id
                  and rfx.to_currency_id=(select id from {currency} where iso_code='HUF')""",
    ),
    "load_interest": Entry(
        on_tables(lambda t: loads.load_interest(fixtures.derive(t, STAGED["ld_interest"]), t)),
        """select r.id rate_id, cast(l.value_date as date) value_date, cast(l.value as double) value
        from {ld_interest} l left join {rate} r on l.rate_name=r.rate_name""",
    ),
    "load_index_dedup": Entry(
        on_tables(lambda t: loads.load_index_dedup(
            fixtures.derive(t, STAGED["ld_interest"]), t.replace(rate_value=_old_rates(t)))),
        f"""select * from (select r.id rate_id, cast(l.value_date as date) value_date, cast(l.value as double) value
                       from {{ld_interest}} l left join {{rate}} r on l.rate_name=r.rate_name) b
        where not exists (select 1 from {_ANTI_RATE} k
                          where k.rate_id=b.rate_id and k.value_date=b.value_date)""",
    ),
    "load_fund_price_dedup": Entry(
        on_tables(lambda t: loads.load_fund_price_dedup(t.ld_fund_price, _old_prices(t))),
        f"""select * from (select cast(fund_id as bigint) fund_id, cast(date as date) value_date,
                              cast(price as double) price from {{ld_fund_price}}) b
        where not exists (select 1 from {_ANTI_PRICE} k
                          where k.fund_id=b.fund_id and k.value_date=b.value_date)""",
    ),
    "load_yield_curve_dedup": Entry(
        on_tables(lambda t: loads.load_yield_curve_dedup(t.ld_yield_curve, _old_curve(t))),
        f"""select * from (select cast(currency_id as int) currency_id, cast(tenor as double) tenor, "type",
                              cast(date as date) value_date, cast(yield as double) yield
                       from {{ld_yield_curve}}) b
        where not exists (select 1 from {_ANTI_CURVE} k
                          where k.currency_id=b.currency_id and k.tenor=b.tenor and k."type"=b."type"
                                and k.value_date=b.value_date)""",
    ),
    "exclude_known_dates": Entry(
        on_tables(lambda t: loads.exclude_known_dates(*_known_batch(t))),
        f"""select b.fund_id, b.date, b.price
        from (select fund_id, {_good('value_date', BAD_DAY, 'value_date')} date, price
              from {{fund_price}} where value_date >= date '2001-09-01') b
        where not exists (
            select 1 from (select fund_id, {_good('value_date', BAD_DAY, 'value_date')} value_date
                           from {_ANTI_PRICE} o) k
            where k.fund_id=b.fund_id and k.value_date is not distinct from b.date)""",
    ),
    "refresh_view": Entry(
        _refresh,
        """select 'portfolio_returns' "view", count(*) "rows" from {portfolio_return}
        union all
        select 'account_returns', count(*)
        from {account_return} r join {portfolio_x_account_rltnp} x on x.account_id=r.key_id
        union all
        select 'yield_curve_current', count(*) from {yield_curve} c
        where value_date=(select max(value_date) from {yield_curve} x
                          where x.currency_id=c.currency_id and x."type"=c."type")
        union all
        select 'interest_series', count(*) from {rate_value} v join {rate} r on v.rate_id=r.id
        where r.rate_type='interest'""",
    ),
    "refresh_portfolio_returns": Entry(_refreshed_returns("portfolio_returns"), analytics.ENTRIES["portfolio_returns"].sql),
    "refresh_account_returns": Entry(_refreshed_returns("account_returns"), analytics.ENTRIES["account_returns"].sql),
    "refresh_yield_curve_current": Entry(_refreshed("yield_curve_current", ["yield_curve"]), analytics.ENTRIES["yield_curve_current"].sql),
    "refresh_interest_series": Entry(_refreshed("interest_series", ["rate_value"]), analytics.ENTRIES["interest_series"].sql),
    "refresh_valuation_dates": Entry(_refreshed_valuation_dates, analytics.ENTRIES["update_valuation_date"].sql),
    "fund_price_import": Entry(
        on_tables(lambda t: jobs.fund_prices_by_isin(
            _seventh_table_pages(t).drop("year"), t.replace(fund_price=_old_prices(t)))),
        f"""select p.fund_id, p.value_date, {_FUND_ROW}
        from {{fund_price}} p left join {_ANTI_PRICE} o on p.fund_id=o.fund_id and p.value_date=o.value_date
        where o.fund_id is null""",
    ),
    "fx_import": Entry(
        on_tables(lambda t: jobs.fx_rates(_fx_pages(t), t)),
        f"""select v.rate_id, {_good('v.value_date', BAD_DAY, 'v.value_date')} value_date,
               {_good('v.value_date', OTHER_BAD_DAY, 'v.value')} value
        from {{rate_value}} v where v.rate_id in (select id from {{rate_fx}})""",
    ),
    "interest_import": Entry(
        on_tables(lambda t: jobs.interest_rates(_interest_pages(t), t)),
        f"""select v.rate_id, {_good('v.value_date', BAD_DAY, 'v.value_date')} value_date,
               {_good('v.value_date', OTHER_BAD_DAY, 'v.value')} value
        from {{rate_value}} v where v.rate_id in (select id from {{rate}} where rate_type='interest')""",
    ),
    "index_import": Entry(
        on_tables(lambda t: jobs.index_values(_index_sheet(t), t.replace(rate_value=_old_rates(t)))),
        f"""select rate_id, value_date, value from {{rate_value}}
        where day(value_date)<>{BAD_DAY} and value_date >= date '{fixtures.RATE_VALUE_CUT}'""",
    ),
    "zero_coupon_import": Entry(
        on_tables(lambda t: jobs.zero_coupon_curve(_curve_sheet(t), _curve_before(t, cleaning.ZERO_COUPON))),
        f"""select currency_id, tenor, 'HUF Zero Coupon' "type", value_date, yield from {{yield_curve}}
        where day(value_date)<>{BAD_DAY} and value_date >= date '{fixtures.RATE_VALUE_CUT}'""",
    ),
    "benchmark_import": Entry(
        on_tables(lambda t: jobs.benchmark_curve(_benchmark_sheet(t), _curve_before(t, cleaning.BENCHMARK))),
        f"""select currency_id, nullif(tenor,3650) tenor, 'HUF Benchmark Rates' "type", value_date, yield
        from {{yield_curve}} where tenor=3650 or value_date >= date '{fixtures.RATE_VALUE_CUT}'""",
    ),
    "fund_history_import": Entry(
        on_tables(lambda t: jobs.fund_prices_by_history(_titled_pages(t).drop("year"), t.replace(fund_price=_old_prices(t)))),
        f"select fund_id, value_date, price from {{fund_price}} where value_date >= date '{fixtures.FUND_PRICE_CUT}'",
    ),
    "stream_pages": Entry(_stream_pages, f"select p.fund_id, p.value_date, {_FUND_ROW} from {{fund_price}} p"),
    "stream_ingest": Entry(_stream, "select fund_id, value_date, price from {fund_price}"),
}
