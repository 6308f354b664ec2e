"""The registered queries: each key has a Spark callable and, where SQL can say it, an oracle query.

Oracle queries are written in the plain form (theta joins, correlated subqueries, self joins), the Spark
side in the form that scales. Ratios are rounded to six digits on both sides for the comparison only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake import fixtures
from fundlake.sources.tables import Tables


@dataclass(frozen=True)
class Entry:
    """A registered query and the SQL that gives the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def on_tables(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A callable on (spark, sf_dir) from one on the data model."""
    return lambda spark, sf_dir: build(fixtures.tables(spark, sf_dir))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """``df`` with some columns rounded."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
