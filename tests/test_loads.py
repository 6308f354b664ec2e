import random

import pytest
from pyspark.sql import functions as F

from conftest import day
from fundlake import schemas
from fundlake.functions import cleaning
from fundlake.operators import loads, paging, records
from fundlake.plans import jobs, refresh, review, views
from fundlake.sources import html, monthly, positional, requests, tables
from fundlake.streaming.ingest import stream_ingest, take_batch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


PRICES = "date string, fund_id string, fund_name string, price string"


def test_load_keeps_batch_duplicates_and_null_keys(spark, small_book):
    staged = spark.createDataFrame(
        [("2020-01-03", "10", "f", "1"), ("2020-02-03", "10", "f", "1"), ("2020-02-03", "10", "f", "1"),
         ("bad", "10", "f", "1"), ("2020-02-03", "x", "f", "y")], PRICES)
    got = rows(loads.load_fund_price_dedup(staged, small_book.fund_price))
    assert got == rows(spark.createDataFrame(
        [(10, day("2020-02-03"), 1.0), (10, day("2020-02-03"), 1.0), (10, None, 1.0),
         (None, day("2020-02-03"), None)], "a bigint, b date, c double"))
    assert loads.load_fund_price_dedup(staged, small_book.fund_price, dedup_batch=True).count() == 3


def test_second_load_adds_nothing(spark, small_book):
    staged = spark.createDataFrame([("2020-02-03", "10", "f", "1"), ("2020-02-04", "11", "f", "2")], PRICES)
    target = small_book.fund_price.select("fund_id", "value_date", "price")
    first = loads.load_fund_price_dedup(staged, target)
    assert first.count() == 2
    assert loads.load_fund_price_dedup(staged, target.unionByName(first)).count() == 0


def test_index_load_lets_unknown_names_pass(spark, small_book):
    staged = spark.createDataFrame(
        [("2020-01-06", "1", "EUR/HUF"), ("2020-01-07", "2", "EUR/HUF"), ("2020-01-06", "3", "?")],
        schemas.MODEL["ld_rate_value"])
    assert rows(loads.load_index_dedup(staged, small_book)) == [
        (102, day("2020-01-07"), 2.0), (None, day("2020-01-06"), 3.0)]
    assert loads.load_interest(staged, small_book).count() == 3
    assert rows(loads.load_fx(staged.withColumn("rate_name", F.lit("EUR")).limit(1), small_book)) == [
        (102, day("2020-01-06"), 1.0)]


def test_known_dates_match_null_with_null(spark):
    batch = spark.createDataFrame([(1, None), (1, day("2020-01-01")), (2, None)], "fund_id bigint, date date")
    target = spark.createDataFrame([(1, None), (2, day("2020-01-01"))], "fund_id bigint, value_date date")
    assert rows(loads.exclude_known_dates(batch, target)) == [(1, day("2020-01-01")), (2, None)]


def test_control_tables(small_book):
    assert rows(loads.control_fx(small_book)) == [
        ("EUR", 102, day("2020-01-07"), day("2020-01-01"), day("2020-01-06"))]
    empty = small_book.replace(rate_value=small_book.rate_value.limit(0))
    assert rows(loads.control_fx(empty)) == []
    assert rows(loads.control_fx(empty, include_new=True)) == [
        ("EUR", 102, day("2020-01-01"), day("2020-01-01"), None)]
    funds = {r["fund_id"]: r["import_date_from"]
             for r in loads.control_funds(small_book, loads.isin_in_country("HU")).collect()}
    assert funds == {10: day("2021-01-05"), 11: day("2020-01-07"), 12: day("2020-01-01")}


def test_requests(small_book):
    control = loads.control_fx(small_book)
    iso = requests.plan_requests(control, "u?c={iso_code}&a={import_date}&b={today}", "2020-02-01").first()
    assert iso["url"] == "u?c=EUR&a=2020-01-07&b=2020-02-01"
    slashed = requests.plan_requests(control, "u?a={import_date}", "2020-02-01", requests.SLASHED_DATE).first()
    assert slashed["url"] == "u?a=07%2F01%2F2020"


PAGE = """<HTML><table class="x"><tr><td>skip</td></tr></table>
<p>text</p><table>
 <tr><th>Date</th><th>Price</th></tr>
 <TR class='a'><td> 5 March 2020&nbsp;</td><td><b>1&lt;2 &amp;lt;</b></td><td>more</td></TR>
 <tr><td>only one</td></tr>
 <tr></tr>
</table></HTML>"""


def test_html_table(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    got = [tuple(r) for r in html.extract_html_table(pages, 2, ["page_id"], ["a", "b"]).orderBy("row_no").collect()]
    assert got == [(1, 1, "Date", "Price"), (1, 2, "5 March 2020", "1<2 &lt;"), (1, 3, "only one", None),
                   (1, 4, None, None)]


def test_titled_table(spark):
    captions = "".join("<tr><td>c</td></tr>" for _ in range(5))
    page = (f"<table>{captions}<tr><td>X</td><td>NAV</td><td>NAV Date</td></tr>"
            "<tr><td>a</td><td>1.5</td><td>31.12.2020</td></tr><tr><td>footer</td></tr></table>")
    pages = spark.createDataFrame([(7, "f", page)], "fund_id int, fund_name string, html string")
    found = html.extract_titled_table(pages, 1, ["fund_id", "fund_name"], 6, ["NAV Date", "NAV"])
    assert rows(cleaning.clean_cs_price_rows(found)) == [(day("2020-12-31"), 7, "f", "1.5")]


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [("5 March 2020", "1.25%", "A"), ("05 March 2020", " 2 ", "A"), ("March", "x%", "A")], "d string, v string, n string")
    assert [tuple(r) for r in cleaning.clean_ir_rows(raw, "d", "v", "n").collect()] == [
        (day("2020-03-05"), 1.25, "A"), (day("2020-03-05"), 2.0, "A"), (None, None, "A")]
    assert cleaning.clean_fx_rows(raw, "d", "v", "n").filter("value is null").count() == 2
    funds = spark.createDataFrame(
        [("2020.03.05.", "1.5", "1,234,567.5", "0", 1, "f")],
        "date string, price string, net_asset_value string, paid_dividend string, fund_id int, fund_name string")
    assert cleaning.typed_fund_rows(funds).first()["net_asset_value"] == 1234567.5
    assert rows(cleaning.clean_fund_price_rows(funds)) == [(day("2020-03-05"), 1, "f", 1.5)]


def test_sheets_by_position(spark, small_book, tmp_path):
    sheet = spark.createDataFrame([("a", "1", None, "2", "z"), ("b", "1", "n", "2", "z")], "p string, q string, r string, s string, t string")
    assert rows(cleaning.clean_yield_curve(sheet, small_book.currency)) == [("b", "1", "2", "HUF Zero Coupon", 0)]
    sheet.write.option("header", "true").csv(str(tmp_path / "sheet"))
    assert rows(positional.read_positional(spark, str(tmp_path / "sheet"), [5, 1], [3])) == [("z", "b")]
    codes = spark.createDataFrame([(c,) for c in ("M3", "Y15", "Y1", None)], "c string")
    got = [r[0] for r in codes.select(cleaning.tenor_days(F.col("c"))).collect()]
    assert got == [90, 5475, None, None]


def test_tables_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, day("2020-01-01"), 2.0)], schemas.PRICE_ROW)
    folder = str(tmp_path)
    tables.append(frame, "p", folder)
    tables.append(frame, "p", folder)
    assert tables.read(spark, "p", folder, schemas.PRICE_ROW).count() == 2
    tables.stage(frame, "p", folder)
    assert tables.read(spark, "p", folder, schemas.PRICE_ROW).count() == 1
    with pytest.raises(tables.SchemaMismatch, match="last_modification: missing"):
        tables.read(spark, "p", folder, schemas.MODEL["fund_price"])


def test_a_wrong_frame_is_not_written(spark, tmp_path):
    folder = str(tmp_path)
    frame = spark.createDataFrame([(1, day("2020-01-01"), 2.0)], schemas.PRICE_ROW)
    tables.stage(frame, "p", folder, schemas.PRICE_ROW)
    for wrong in (frame.drop("price"), frame.withColumn("price", F.lit("2")), frame.withColumn("more", F.lit(1))):
        for put in (tables.append, tables.stage):
            with pytest.raises(tables.SchemaMismatch):
                put(wrong, "p", folder, schemas.PRICE_ROW)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p"]
    # a table may be replaced by rows made from itself
    tables.stage(tables.read(spark, "p", folder, schemas.PRICE_ROW).withColumn("price", F.col("price") + 1), "p", folder, schemas.PRICE_ROW)
    assert rows(tables.read(spark, "p", folder, schemas.PRICE_ROW).select("price")) == [(3.0,)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p"]


def test_a_failed_write_keeps_the_table(spark, tmp_path):
    folder = str(tmp_path)
    frame = spark.createDataFrame([(1, day("2020-01-01"), 2.0)], schemas.PRICE_ROW)
    tables.stage(frame, "p", folder, schemas.PRICE_ROW)
    failing = frame.withColumn("price", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        tables.stage(failing, "p", folder, schemas.PRICE_ROW)
    assert tables.read(spark, "p", folder, schemas.PRICE_ROW).count() == 1


def test_records(spark, small_book, tmp_path):
    entered = records.add_deposit(spark.createDataFrame(
        [("1", "2020-01-01", "5", "2020-02-01", "", "fixed", "", None),
         ("1", "2020-01-01", "5", "2020-02-01", "2", "variable", "201", "0.5"),
         ("1", "2020-01-01", "5", "2020-02-01", "2", "variable", "999", "0.5"),
         ("9", "2020-01-01", "5", "2020-02-01", "2", "fixed", "", ""),
         ("1", "01/01/2020", "5", "2020-02-01", "2", "other", "", "")],
        "account_id string, value_date string, amount string, maturity_date string, interest_rate string,"
        " interest_rate_type string, reference_rate_id string, interest_rate_spread string"), small_book)
    assert rows(entered.accepted.select("interest_rate", "reference_rate_id", "interest_rate_spread")) == [
        (0.0, None, 0.0), (2.0, 201, 0.5)]
    assert sorted(r["reason"] for r in entered.rejected.collect()) == [
        "account_id is unknown", "reference_rate_id is unknown", "value_date is no date"]


def test_ids_are_dense_over_tasks_and_entries(spark, tmp_path):
    folder = str(tmp_path)
    schema = schemas.MODEL["rate"]
    tables.append(spark.createDataFrame([(41, "old", "FX", None)], schema), "rate", folder)
    for n, parts in ((50, 7), (0, 2), (9, 3)):
        fresh = spark.range(n).repartition(parts).select(F.concat(F.lit("r"), "id").alias("rate_name"), F.lit("FX").alias("rate_type"))
        back = records.store(fresh, "rate", folder, "2024-01-01")
        assert back.count() == n and back.schema["id"].dataType == schema["id"].dataType
    assert sorted(r["id"] for r in tables.read(spark, "rate", folder).collect()) == list(range(41, 101))
    # the last id comes from the table of reservations, not from the rows
    assert records.reserve_ids(spark, "rate", folder, 5) == 101 and records.reserve_ids(spark, "rate", folder, 1) == 106
    assert records.reserve_ids(spark, "new", folder, 1) == 1


def test_new_investment_shows_in_the_overview(spark, small_book, tmp_path):
    folder = str(tmp_path)
    name = "fund_investment_transaction"
    tables.append(small_book[name], name, folder)
    views_ = refresh.refresh_views(spark, f"{folder}/views", small_book)
    entered = records.add_investment(
        spark.createDataFrame([("2020-01-06", "2", "2", "11")],
                              "value_date string, share_amount string, account_id string, fund_id string"),
        small_book)
    fresh = records.append_records(entered, name, folder)
    t = small_book.replace(fund_investment_transaction=tables.read(spark, name, folder))
    views_.refresh("portfolio_returns", t, {name: fresh})
    assert [c.kind for c in views_.commits("portfolio_returns")] == ["whole", "again"]
    last = views_.read("portfolio_returns", t).filter("portfolio_id = 1 and date = '2020-01-06'").first()
    assert (last["market_value"], last["cash_flow"]) == (16.5, 4.0)
    assert rows(views_.read("portfolio_returns", t)) == rows(views.portfolio_returns(t))


def test_entered_records_are_read_back_through_the_checked_scan(spark, small_book, tmp_path):
    folder = str(tmp_path)
    given = {
        "rate": records.add_rate(spark.createDataFrame(
            [("A", "FX"), ("B", "interest"), ("C", "none")], "rate_name string, rate_type string").repartition(3)),
        "account": records.add_account(spark.createDataFrame(
            [("new", "Y", "15", "2", "2021-01-01"), ("bad", "Y", "15", "99", "2021-01-01")],
            "account_name string, tax_applicable string, tax_rate_percent string, currency_id string, date_open string"), small_book),
    }
    for name, entered in given.items():
        tables.append(small_book[name], name, folder)
        before = tables.read(spark, name, folder).count()
        records.append_records(entered, name, folder, "2024-01-01")
        after = tables.read(spark, name, folder)
        assert after.count() == before + entered.accepted.count() == after.select("id").distinct().count()
        assert after.where("last_modification = '2024-01-01'").count() == entered.accepted.count() > 0
    assert sorted(r["id"] for r in tables.read(spark, "rate", folder).collect()) == [102, 201, 202, 203]


def landed(spark, landing, *staged):
    spark.createDataFrame(list(staged), PRICES).coalesce(1).write.mode("append").option("header", "true").csv(landing)


KEY = ["fund_id", "value_date"]


def test_stream_takes_each_file_once_and_later_files_too(spark, small_book, tmp_path):
    folder, landing = str(tmp_path), str(tmp_path / "landing")
    monthly.write(small_book.fund_price.select(*KEY, "price"), "fund_price", folder, "first", schema=schemas.PRICE_ROW)

    def run():
        stream_ingest(spark, landing, schemas.MODEL["ld_fund_price"], loads.typed_fund_prices, KEY, "fund_price", folder,
                      schemas.PRICE_ROW, f"{folder}/checkpoint", fmt="csv", header="true")
        return monthly.read(spark, "fund_price", folder, schemas.PRICE_ROW).count()

    landed(spark, landing, ("2020-01-03", "10", "f", "9"), ("2020-02-03", "10", "f", "1"), ("2020-02-03", "10", "f", "1"))
    assert run() == 6
    assert run() == 6
    landed(spark, landing, ("2020-02-03", "10", "f", "1"), ("2020-02-04", "10", "f", "1"))
    assert run() == 7


def test_a_repeated_batch_adds_nothing(spark, small_book, tmp_path):
    """Rows without a key, and duplicates that differ in price, in another order each time."""
    folder = str(tmp_path)
    staged = [("2020-02-03", "10", "f", "5"), ("2020-02-03", "10", "f", "1"), (None, "10", "f", "7"), ("2020-03-01", "x", "f", "8"),
              ("2020-03-04", "11", "f", "2"), (None, "10", "f", "7")]

    def take(given, load):
        take_batch(spark.createDataFrame(given, PRICES), load, loads.typed_fund_prices, KEY, "fund_price", folder, schemas.PRICE_ROW)
        return (rows(monthly.read(spark, "fund_price", folder, schemas.PRICE_ROW)),
                rows(monthly.read(spark, "fund_price_rejected", folder, schemas.PRICE_ROW)))

    first = take(staged, "a-1")
    assert [r[:3] for r in first[0]] == [(10, day("2020-02-03"), 1.0), (11, day("2020-03-04"), 2.0)]
    assert len(first[1]) == 3
    assert take(staged[::-1], "a-1") == first
    more = take([("2020-03-04", "11", "f", "1"), ("2020-03-05", "11", "f", "4")], "a-2")
    assert len(more[0]) == 3 and more[1] == first[1]
    assert take(staged, "a-1") == more


def test_months_that_a_load_does_not_touch_are_not_read(spark, tmp_path):
    folder = str(tmp_path)
    old = spark.createDataFrame([(10, day("2019-05-03"), 1.0), (10, day("2020-03-03"), 1.0), (10, None, 3.0)], schemas.PRICE_ROW)
    monthly.write(old, "fund_price", folder, "first", schema=schemas.PRICE_ROW)
    broken = list((tmp_path / "fund_price" / "load=first" / "month=2019-05").glob("*.parquet"))
    assert broken
    for path in broken:  # reading this month would fail
        path.write_bytes(b"no parquet")
    target = monthly.read(spark, "fund_price", folder, schemas.PRICE_ROW)
    staged = spark.createDataFrame([("2020-03-03", "10", "f", "1"), ("2020-03-04", "10", "f", "1")], PRICES)
    assert rows(loads.load_fund_price_dedup(staged, target)) == [(10, day("2020-03-04"), 1.0)]
    fetched = spark.createDataFrame([(10, day("2020-03-03")), (10, None), (11, None)], "fund_id bigint, date date")
    assert rows(loads.exclude_known_dates(fetched, target)) == [(11, None)]


def test_pages_of_a_load_are_parsed_once(spark, small_book, tmp_path):
    """The plan that is left after staging neither has patterns nor a second scan of the target."""
    prices = str(tmp_path / "prices")
    small_book.fund_price.write.parquet(prices)
    pages = spark.createDataFrame([(10, "f", "<table></table>" * 6 + "<table><tr><td>d</td></tr><tr><td>2021.01.05.</td><td>5</td></tr></table>")],
                                  "fund_id bigint, fund_name string, html string")
    batch = jobs.fetched_fund_prices(pages)
    fresh = loads.load_fund_price_dedup(batch, spark.read.parquet(prices))
    text = fresh._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in text and text.count(f"{prices}") == 1 and "GreaterThanOrEqual(value_date,2021-01-05)" in text
    assert rows(fresh) == [(10, day("2021-01-05"), 5.0)]


def test_deep_pages(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "c"]) if i % 3 else "a") for i in range(900)]
    df = spark.createDataFrame(data, "id int, x int, y string").repartition(5)
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[0]))
    for skip in (0, 95, 430, 890, 2000):
        got = [tuple(r) for r in paging.rows_in_order(df, ["-x", "y", "id"], skip, 10, sort_rows=40).collect()]
        assert got == order[skip:skip + 10]
    # rows with equal keys cannot be parted, but a page is whole
    assert len(paging.rows_in_order(df, ["-x"], 200, 10, sort_rows=40).collect()) == 10
    assert paging.rows_in_order(df.limit(0), ["id"], 200, 10, sort_rows=40).count() == 0


def test_nested_tables(spark):
    cell = "<tr><td>{}</td><td>x</td></tr>"
    inner = "<table>" + cell.format("inner") + "</table>"
    seventh = "<TABLE class='t'>" + cell.format("first") + "<tr><td>a" + inner + "b</td></tr>" + cell.format("last") + "</TABLE>"
    page = "<table>" * 1 + "<tr><td>" + inner * 5 + seventh + "</td></tr></table>" + "<table>" + cell.format("ninth") + "</table>"
    pages = spark.createDataFrame([(1, page), (2, "no table"), (3, None), (4, inner * 7)], "id int, html string")

    def cells(number):
        return [tuple(r) for r in html.extract_html_table(pages, number, ["id"], ["c"]).orderBy("id", "row_no").collect()]

    assert cells(7) == [(1, 1, "first"), (1, 2, "ab"), (1, 3, "last"), (4, 1, "inner")]
    assert cells(9) == [(1, 1, "ninth")]
    assert cells(8) == [(1, 1, "inner")] and cells(10) == []


def test_paging_and_selectors(small_book):
    page = review.table_page(small_book.fund.select("id", "fund_name"), ["id"], page=2, search="FUND", rows=2)
    assert rows(page) == [(12, "fund 12")]
    assert rows(review.table_page(small_book.fund.select("id", "fund_name"), ["id"], search="12")) == [(12, "fund 12")]
    assert rows(review.selector_interest_rate(small_book)) == [("BASE", "201"), ("please select..", "")]


def test_current_curve(spark):
    curve = spark.createDataFrame(
        [(0, 90.0, "A", day("2020-01-01"), 1.0), (0, 90.0, "A", day("2020-01-02"), 2.0),
         (0, 365.0, "A", day("2020-01-02"), 3.0), (0, 90.0, "B", day("2020-01-01"), 4.0)], schemas.MODEL["yield_curve"])
    assert rows(views.yield_curve_current(curve).select("type", "tenor", "yield")) == [
        ("A", 365.0, 3.0), ("A", 90.0, 2.0), ("B", 90.0, 4.0)]
