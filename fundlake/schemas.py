"""Table schemas as Spark types.

``MODEL`` is the relational data model of the engine. ``SOURCE`` lists the columns of the
given Parquet tables that the fixture mapping reads.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(columns: str) -> T.StructType:
    """``"id int, name string"`` as a schema; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MODEL: dict[str, T.StructType] = {
    "currency": _schema("id int, iso_code string, description string, last_modification timestamp"),
    "account": _schema(
        "id bigint, account_name string, tax_applicable string, tax_rate_percent double,"
        " currency_id int, date_open date, last_modification timestamp"
    ),
    "deposit": _schema(
        "id bigint, account_id bigint, value_date date, maturity_date date, amount double,"
        " interest_rate double, interest_rate_type string, reference_rate_id int,"
        " interest_rate_spread double, last_modification timestamp"
    ),
    "fund": _schema(
        "id bigint, fund_name string, isin string, currency_id int, source_id string,"
        " inception_date date, description string, last_modification timestamp"
    ),
    "fund_price": _schema(
        "id bigint, fund_id bigint, value_date date, price double, last_modification timestamp"
    ),
    "fund_investment_transaction": _schema(
        "id bigint, value_date date, share_amount double, account_id bigint, fund_id bigint,"
        " last_modification timestamp"
    ),
    "cash_transaction": _schema("id bigint, account_id bigint, amount double, value_date date"),
    "rate": _schema("id int, rate_name string, rate_type string, last_modification timestamp"),
    "rate_fx": _schema("id int, from_currency_id int, to_currency_id int"),
    "rate_value": _schema(
        "id bigint, rate_id int, value_date date, value double, last_modification timestamp"
    ),
    "portfolio": _schema("id int, name string, description string, last_valuation_date date"),
    "portfolio_x_account_rltnp": _schema("portfolio_id int, account_id bigint"),
    "yield_curve": _schema(
        "currency_id int, tenor double, type string, value_date date, yield double"
    ),
    "ld_rate_value": _schema("value_date string, value string, rate_name string"),
    "ld_fund_price": _schema("date string, fund_id string, fund_name string, price string"),
    "ld_yield_curve": _schema(
        "date string, tenor string, yield string, type string, currency_id string"
    ),
}

# Prices as loaded, before the store gives an id and a time stamp.
PRICE_ROW = _schema("fund_id bigint, value_date date, price double")

SOURCE: dict[str, T.StructType] = {
    "region": _schema("r_regionkey int, r_name string"),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _schema(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": _schema("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "orders": _schema(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": _schema(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}
