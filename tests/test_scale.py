"""Operators against brute force, and the shape of the plans."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fundlake import fixtures, registry
from fundlake.operators.loads import load_fund_price_dedup
from fundlake.operators.range_join import join_dates_in_interval
from fundlake.operators.repeat import repeat_rows
from fundlake.plans import series, statements, views


def some_day(rng):
    return datetime.date(2019, 11, 1) + datetime.timedelta(rng.randrange(900))


@pytest.mark.parametrize("limit", [500, 20_000_000])
def test_range_join_equals_brute_force(spark, limit):
    rng = random.Random(7)
    intervals = []
    for i in range(120):
        a, b = some_day(rng), some_day(rng)
        key = 1 if i % 3 else rng.randrange(5)  # one key holds most intervals
        intervals.append((i, key, a, b))
    points = [(k, d, float(i)) for i, (k, d) in enumerate({(rng.randrange(5), some_day(rng)) for _ in range(400)})]
    left = spark.createDataFrame(intervals, "i int, k int, a date, b date")
    right = spark.createDataFrame(points, "k int, d date, v double")
    got = join_dates_in_interval(left, right, ["k"], "a", "b", "d", limit).select("i", "d", "v")
    want = {(i, d, v) for i, k, a, b in intervals for q, d, v in points if k == q and a <= d < b}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_range_join_of_nothing(spark):
    left = spark.createDataFrame([(1, 2, datetime.date(2020, 1, 1), datetime.date(2020, 1, 1))], "i int, k int, a date, b date")
    right = spark.createDataFrame([(2, datetime.date(2020, 1, 1), 1.0)], "k int, d date, v double")
    assert join_dates_in_interval(left, right, ["k"], "a", "b", "d").count() == 0
    assert join_dates_in_interval(left.limit(0), right.limit(0), ["k"], "a", "b", "d").count() == 0


def test_a_hot_fund_is_cut_by_joined_rows(spark):
    """Half of all intervals are on one fund: no task joins more rows than allowed, and nothing is broadcast."""
    limit, day = 60_000, F.lit(datetime.date(2020, 1, 1))
    fund = F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50)
    held = spark.range(4_000).select("id", fund.alias("k"), F.date_add(day, (F.col("id") % 300).cast("int")).alias("a"),
                                     F.date_add(day, (F.col("id") % 300 + 200).cast("int")).alias("b"))
    prices = spark.range(50).select(F.col("id").alias("k"), F.explode(F.sequence(day, F.date_add(day, 600))).alias("d"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_dates_in_interval(held, prices, ["k"], "a", "b", "d", limit)
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(r["count"] for r in tasks) == 4_000 * 200
    assert max(r["count"] for r in tasks) <= limit and len(tasks) >= 14
    assert "Broadcast" not in text and "CartesianProduct" not in text


def test_price_development_scans_and_sorts_prices_once(spark, small_book, tmp_path):
    for name in ("fund_price", "fund_investment_transaction", "fund"):
        small_book[name].write.parquet(str(tmp_path / name))
    t = small_book.replace(**{n: spark.read.parquet(str(tmp_path / n)) for n in ("fund_price", "fund_investment_transaction", "fund")})
    text = plan(series.fund_price_development(t))
    assert text.count("ReadSchema: struct<fund_id:bigint,value_date:date,price:double>") == 1, text
    assert text.count("- Window [") == 1, text


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_repeat_rows(spark, chunk):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 23)], "x string, n bigint")
    got = {r["x"]: r["count"] for r in repeat_rows(df, "n", chunk).groupBy("x").count().collect()}
    assert got == {"a": 1, "b": 7, "c": 23}
    text = plan(repeat_rows(df, "n", chunk))
    assert text.count("Scan") == 1 and "Union" not in text and text.count("Generate explode") == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "portfolio_performance_ts", "annualized_return_expanding", "account_balance_history", "portfolio_returns",
    "account_returns", "portfolio_statement", "fund_price_development", "load_fund_price_dedup",
    "html_table_extract", "key_figures",
])
def test_no_cross_joins_and_no_python(spark, sf_dir, key):
    text = plan(registry.queries()[key](spark, sf_dir))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


def test_scan_reads_needed_columns_only(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    text = plan(views.fund_price_recent(t.fund_price))
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_load_prunes_the_target_scan(spark, small_book, tmp_path):
    path = str(tmp_path / "prices")
    small_book.fund_price.write.parquet(path)
    staged = spark.createDataFrame([("2021-01-04", "10", "f", "1")],
                                   "date string, fund_id string, fund_name string, price string")
    fresh = load_fund_price_dedup(staged, spark.read.parquet(path))
    assert fresh.count() == 0
    text = plan(fresh)
    assert "ReadSchema: struct<fund_id:bigint,value_date:date>" in text
    assert "GreaterThanOrEqual(value_date,2021-01-04)" in text


def test_statement_sums_before_it_joins_accounts(spark, sf_dir):
    """Lots are never shuffled by account: the account join comes after the partial sums."""
    t = fixtures.tables(spark, sf_dir)
    optimized = views.statement_amounts(t)._jdf.queryExecution().optimizedPlan().toString()
    lines = optimized.splitlines()
    top_join = next(i for i, line in enumerate(lines) if "Join Inner, (account_id" in line)
    aggregate = next(i for i, line in enumerate(lines) if "Aggregate [account_id" in line)
    assert top_join < aggregate


def test_statement_of_portfolios_sums_accounts(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    account = views.statement_amounts(t).groupBy("currency").agg(F.sum("market").alias("m"))
    portfolio = (
        views.statement_amounts(t).join(t.portfolio_x_account_rltnp.filter("portfolio_id < 10"), "account_id")
        .groupBy("currency").agg(F.sum("market").alias("m"))
    )
    assert sorted(map(tuple, account.collect())) == sorted(map(tuple, portfolio.collect()))


def test_last_balance_is_the_plain_sum(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    last = series.account_balance_history(t, fixtures.AS_OF, ordered=False).filter("reporting_period = '2001-07-31'")
    plain = (
        t.cash_transaction.filter("value_date < '2001-08-01'").groupBy("account_id")
        .agg(F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("balance"))
    )
    columns = ["account_id", "balance"]
    assert sorted(map(tuple, last.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_recent_return_is_one_of_the_expanding_ones(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    recent = series.recent_annualized_return(t)
    expanding = series.annualized_return_expanding(views.portfolio_returns(t))
    assert recent.count() > 0
    assert recent.join(expanding, ["portfolio", "date", "ann_yield_pct"], "left_anti").count() == 0


def test_unordered_reports_have_the_same_rows(small_book):
    ordered = statements.lot_performance(small_book)
    assert ordered.exceptAll(statements.lot_performance(small_book, ordered=False)).count() == 0


def test_a_hot_account_is_split(spark, small_book):
    """Half of all lots belong to one account: adaptive execution splits its join partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    account = F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id"))
    lots = spark.range(0, 60_000, 1, 8).select(
        account.alias("account_id"), (F.col("id") % 97).alias("fund_id"),
        F.lit(datetime.date(2020, 1, 2)).alias("value_date"), F.rand(1).alias("share_amount"))
    members = spark.range(0, 60_000, 1, 8).select(F.lit(1).alias("portfolio_id"), F.col("id").alias("account_id"))
    t = small_book.replace(fund_investment_transaction=lots, portfolio_x_account_rltnp=members)
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = views.portfolio_lots(t).groupBy("fund_id").count()
        assert sum(r["count"] for r in joined.collect()) == 60_000
        assert "skew=true" in plan(joined)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_reports_do_not_change_when_keys_are_split(spark, sf_dir, monkeypatch):
    t = fixtures.tables(spark, sf_dir)
    plain = views.portfolio_returns(t).collect()
    monkeypatch.setattr(join_dates_in_interval, "__defaults__", (20_000,))
    split = views.portfolio_returns(fixtures.tables(spark, sf_dir)).collect()
    assert sorted(map(tuple, plain), key=repr) == sorted(map(tuple, split), key=repr)
