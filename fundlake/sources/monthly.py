"""Tables kept by load and month: a repeated load replaces its own rows, and a scan meets only the months it needs.

Folders are ``name/load=.../month=yyyy-MM`` (``month=none`` for rows without a date). A load is written beside the table
and then moved to its place, so readers see all of it or nothing.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlake import schemas
from fundlake.sources import tables

LOAD, MONTH, NO_MONTH = "load", "month", "none"


def month_of(date: str) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))


def write(df: DataFrame, name: str, directory: str, load: str, date: str = "value_date", schema: T.StructType | None = None) -> None:
    """Put the rows of one load into the table, in place of an earlier try of the same load."""
    rows = tables.checked(df, name, schema).withColumn(MONTH, month_of(date))
    path = f"{directory}/{name}/{LOAD}={load}"
    beside = f"{directory}/_{name}-{uuid.uuid4().hex}"
    # a month's rows go to as many tasks as adaptive execution finds fit
    rows.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(beside)
    tables.make_folder(df.sparkSession, f"{directory}/{name}")
    tables.switch(df.sparkSession, beside, path)


def read(spark: SparkSession, name: str, directory: str, schema: T.StructType | None = None, without_load: str | None = None) -> DataFrame:
    """The declared columns and ``month``, all loads but one; an absent table is empty."""
    expected = schema or schemas.MODEL[name]
    full = T.StructType([*expected.fields, T.StructField(LOAD, T.StringType()), T.StructField(MONTH, T.StringType())])
    path = f"{directory}/{name}"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], full).drop(LOAD)
    rows = spark.read.schema(full).parquet(path)
    if without_load is not None:
        rows = rows.filter(F.col(LOAD) != without_load)
    return rows.drop(LOAD)


def since(rows: DataFrame, first: datetime.date | None, date: str) -> DataFrame:
    """Rows from the day on, of these months only if the table is kept by month; no day: no rows."""
    if first is None:
        return rows.filter(F.lit(False))
    rows = rows.filter(F.col(date) >= F.lit(first))
    return rows.filter(F.col(MONTH) >= first.strftime("%Y-%m")).drop(MONTH) if MONTH in rows.columns else rows
