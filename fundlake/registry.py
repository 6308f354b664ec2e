"""All registered queries by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundlake.catalog import Entry, analytics, entry_forms, ingest
from fundlake.catalog.oracle import render

ENTRIES: dict[str, Entry] = {
    **ingest.ENTRIES, **analytics.ENTRIES, **entry_forms.ENTRIES,
}
_EXTRA = {**ingest.STAGED, **entry_forms.RECORDS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Key -> callable on (spark, sf_dir)."""
    return {key: entry.run for key, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    """Key -> SQL on the given tables."""
    return {key: render(entry.sql, _EXTRA) for key, entry in ENTRIES.items() if entry.sql}
