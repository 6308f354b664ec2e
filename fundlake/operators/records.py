"""Entry of new records: typed, checked against keys, split into accepted and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlake import schemas
from fundlake.sources import tables
from fundlake.sources.tables import Tables


class Entered(NamedTuple):
    """Typed rows ready to append, and the rows as entered with the reason of their rejection."""

    accepted: DataFrame
    rejected: DataFrame


class Field(NamedTuple):
    """A column of the record: how it is read from text and the check it must pass."""

    name: str
    value: Column
    valid: Column
    reason: str


class Reference(NamedTuple):
    """A column that must name a row of another table, or be NULL."""

    field: str
    keys: DataFrame


def _text(name: str) -> Field:
    return Field(name, F.col(name), F.col(name).isNotNull(), f"{name} is missing")


def _number(name: str) -> Field:
    value = F.col(name).try_cast("double")
    return Field(name, value, value.isNotNull(), f"{name} is no number")


def _number_or_zero(name: str) -> Field:
    """An empty entry counts as 0."""
    value = F.coalesce(F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit("")), F.lit("0")).try_cast("double")
    return Field(name, value, value.isNotNull(), f"{name} is no number")


def _key(name: str, kind: str) -> Field:
    value = F.col(name).try_cast(kind)
    return Field(name, value, value.isNotNull(), f"{name} is no key")


def _optional_key(name: str, kind: str) -> Field:
    """An empty entry is NULL."""
    entered = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    value = entered.try_cast(kind)
    return Field(name, value, entered.isNull() | value.isNotNull(), f"{name} is no key")


def _date(name: str) -> Field:
    value = F.try_to_date(F.col(name), "yyyy-MM-dd")
    return Field(name, value, value.isNotNull(), f"{name} is no date")


def _one_of(name: str, *choices: str) -> Field:
    return Field(name, F.col(name), F.coalesce(F.col(name).isin(*choices), F.lit(False)),
                 f"{name} must be {' or '.join(choices)}")


def enter(records: DataFrame, fields: Sequence[Field], references: Sequence[Reference] = ()) -> Entered:
    """Split ``records`` (text columns); the first failing check gives the reason.

    Each reference is one left join with the keys of the other table, and the decided rows are kept in scratch, so that neither
    accepted nor rejected rows compute them again.
    """
    entered = F.struct(*[F.col(f.name) for f in fields])
    failures = [F.when(~f.valid, F.lit(f.reason)) for f in fields]
    decided = records.select(
        entered.alias("_entered"), F.coalesce(*failures).alias("reason"),
        *[f.value.alias(f.name) for f in fields],
    )
    for field, keys in references:
        known = keys.toDF("_key").distinct().withColumn("_known", F.lit(True))
        unknown = F.col(field).isNotNull() & F.col("_known").isNull()
        decided = (
            decided.join(known, F.col(field) == F.col("_key"), "left")
            .withColumn("reason", F.coalesce("reason", F.when(unknown, F.lit(f"{field} is unknown"))))
            .drop("_key", "_known")
        )
    decided = tables.stored(decided, "entered")
    accepted = decided.filter(F.col("reason").isNull()).select(*[f.name for f in fields])
    rejected = decided.filter(F.col("reason").isNotNull()).select("_entered.*", "reason")
    return Entered(accepted, rejected)


def add_account(records: DataFrame, t: Tables) -> Entered:
    return enter(
        records,
        [_text("account_name"), _one_of("tax_applicable", "Y", "N"), _number("tax_rate_percent"),
         _key("currency_id", "int"), _date("date_open")],
        [Reference("currency_id", t.currency.select("id"))],
    )


def add_deposit(records: DataFrame, t: Tables) -> Entered:
    return enter(
        records,
        [_key("account_id", "bigint"), _date("value_date"), _number("amount"), _date("maturity_date"),
         _number_or_zero("interest_rate"), _one_of("interest_rate_type", "fixed", "variable"),
         _optional_key("reference_rate_id", "int"), _number_or_zero("interest_rate_spread")],
        [Reference("account_id", t.account.select("id")),
         Reference("reference_rate_id", t.rate.select("id"))],
    )


def add_fund(records: DataFrame, t: Tables) -> Entered:
    return enter(
        records,
        [_text("fund_name"), _text("isin"), _key("currency_id", "int"), _text("source_id"),
         _date("inception_date"), _text("description")],
        [Reference("currency_id", t.currency.select("id"))],
    )


def add_rate(records: DataFrame) -> Entered:
    return enter(records, [_text("rate_name"), _one_of("rate_type", "interest", "FX")])


def add_currency(records: DataFrame) -> Entered:
    return enter(records, [_text("iso_code"), _text("description")])


def add_investment(records: DataFrame, t: Tables) -> Entered:
    return enter(
        records,
        [_date("value_date"), _number("share_amount"), _key("account_id", "bigint"),
         _key("fund_id", "bigint")],
        [Reference("account_id", t.account.select("id")), Reference("fund_id", t.fund.select("id"))],
    )


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """The rows with ids ``first``, ``first`` + 1 and so on, without a gap.

    Each task numbers its own rows and writes them with its number; the counts of the tasks, one row each, give
    the offsets. No row is moved or sorted.
    """
    place = F.monotonically_increasing_id()  # the task's number above 33 bits that count its rows
    kept = tables.stored(rows.select("*", F.shiftright(place, 33).alias("_task"), place.bitwiseAND((1 << 33) - 1).alias("_row")), "numbered")
    counts = kept.groupBy("_task").agg(F.count("*").alias("n")).orderBy("_task").collect()
    offsets, total = [], first
    for task in counts:
        offsets.append((task["_task"], total))
        total += task["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "_task bigint, _first bigint")
    return kept.join(F.broadcast(starts), "_task").withColumn("id", F.col("_first") + F.col("_row")).drop("_task", "_row", "_first")


def reserve_ids(spark: SparkSession, name: str, directory: str, n: int) -> int:
    """The first of ``n`` new ids of a stored table.

    The table ``name_ids`` holds the last id given out, one row per reservation. Only when it is missing the largest id of
    the table is looked up. The reservation is written before the rows: a failure leaves a gap, never an id twice.
    """
    path = f"{directory}/{name}_ids"
    if tables.exists(spark, path):
        last = spark.read.schema("last bigint").parquet(path).agg(F.max("last")).first()[0]
    elif tables.exists(spark, f"{directory}/{name}"):
        last = spark.read.parquet(f"{directory}/{name}").agg(F.max("id")).first()[0]
    else:
        last = None
    last = int(last or 0)
    spark.createDataFrame([(last + n,)], "last bigint").coalesce(1).write.mode("append").parquet(path)
    return last + 1


def as_stored(rows: DataFrame, target: T.StructType, loaded_at: str | None = None) -> DataFrame:
    """``rows`` with the columns and types of ``target``: the given or the current time as ``last_modification``, NULL
    for other columns they lack."""
    if "last_modification" in target.fieldNames():
        stamp = F.lit(loaded_at).cast("timestamp") if loaded_at else F.current_timestamp()
        rows = rows.withColumn("last_modification", stamp)
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.fields
    ])


def store(rows: DataFrame, name: str, directory: str, loaded_at: str | None = None, target: T.StructType | None = None) -> DataFrame:
    """Append ``rows`` to a stored table with new ids and a time stamp, and return what was appended."""
    target = target or schemas.MODEL[name]
    if "id" in target.fieldNames():
        kept = tables.stored(rows, name)
        rows = numbered(kept, reserve_ids(rows.sparkSession, name, directory, kept.count()))
    full = tables.stored(as_stored(rows, target, loaded_at), name)
    tables.append(full, name, directory, target)
    return full


def append_records(entered: Entered, name: str, directory: str, loaded_at: str | None = None,
                   target: T.StructType | None = None) -> DataFrame:
    """Append the accepted rows to the stored table and return them as stored; views are refreshed with these
    rows by the caller."""
    return store(entered.accepted, name, directory, loaded_at, target)
