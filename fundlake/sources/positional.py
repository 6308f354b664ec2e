"""Sheets whose columns are known by position only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def by_position(sheet: DataFrame, keep: Sequence[int], required: Sequence[int] = (),
                names: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (from 1) of the rows that have a value in every ``required`` position."""
    columns = sheet.columns
    rows = sheet.dropna(how="any", subset=[columns[i - 1] for i in required]) if required else sheet
    picked = rows.select(*[columns[i - 1] for i in keep])
    return picked.toDF(*names) if names else picked


def read_positional(spark: SparkSession, path: str, keep: Sequence[int], required: Sequence[int] = (),
                    names: Sequence[str] | None = None, **options: str) -> DataFrame:
    """The same on delimited files with a header line; all cells are text, an empty cell is NULL."""
    sheet = spark.read.options(**{"header": "true", **options}).csv(path)
    return by_position(sheet, keep, required, names)
