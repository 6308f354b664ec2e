"""A page deep in an ordered table: counts find the range that holds it, and only that range is sorted."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_ROWS = 100_000  # rows that are sorted at most, unless more rows have equal keys
RANGES = 32  # ranges counted in one scan
SAMPLE = 512


def _key(name: str) -> tuple[str, bool]:
    """Column and whether it is descending: a leading minus sign."""
    return (name[1:], True) if name.startswith("-") else (name, False)


def ordering(order_by: Sequence[str]) -> list[Column]:
    """Ascending with NULLs first; a name with a leading minus sign descending with NULLs last."""
    return [F.desc(c) if down else F.asc(c) for c, down in map(_key, order_by)]


def _from(order_by: Sequence[str], bound: Sequence[object]) -> Column:
    """Whether a row comes at or after the bound in the order."""
    keys, same, ways = [_key(n) for n in order_by], F.lit(True), []
    for (name, down), value in zip(keys, bound, strict=True):
        column = F.col(name)
        if value is None:
            after = F.lit(False) if down else column.isNotNull()
        elif down:
            after = column.isNull() | (column < F.lit(value))
        else:
            after = column > F.lit(value)
        ways.append(same & F.coalesce(after, F.lit(False)))
        same = same & column.eqNullSafe(F.lit(value))
    return functools.reduce(operator.or_, ways, same)


def _bounds(df: DataFrame, order_by: Sequence[str]) -> list[tuple]:
    """Up to RANGES keys spread over the rows, in order."""
    names = [_key(n)[0] for n in order_by]
    keys = df.select(*names)
    some = keys.orderBy(F.xxhash64(*names, F.monotonically_increasing_id())).limit(SAMPLE)
    found = [tuple(r) for r in some.distinct().orderBy(*ordering(order_by)).collect()]
    step = max(1, len(found) // RANGES)
    return found[step // 2::step]


def rows_in_order(df: DataFrame, order_by: Sequence[str], skip: int, rows: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """The ``rows`` rows after the first ``skip`` ones, in order.

    A page near the beginning is a top-k. For a deeper one the rows are counted by ranges of the order key, the range
    that holds the page is kept, and this goes on until it is small enough to be sorted.
    """
    order, narrowed = ordering(order_by), df
    while skip + rows > sort_rows:
        bounds = _bounds(narrowed, order_by)
        place = functools.reduce(operator.add, [_from(order_by, b).cast("int") for b in bounds], F.lit(0))
        counts = dict(narrowed.groupBy(place.alias("_range")).count().collect())
        first, before = 0, 0
        while first < len(bounds) and before + counts.get(first, 0) <= skip:
            before += counts.get(first, 0)
            first += 1
        last, held = first, counts.get(first, 0)
        while last < len(bounds) and before + held < skip + rows:
            last += 1
            held += counts.get(last, 0)
        if held == sum(counts.values()):
            break  # rows of equal keys, which no bound parts
        narrowed = narrowed.filter(_from(order_by, bounds[first - 1])) if first else narrowed
        narrowed = narrowed.filter(~_from(order_by, bounds[last])) if last < len(bounds) else narrowed
        skip -= before
        if held <= sort_rows:
            break
    return narrowed.orderBy(*order).offset(skip).limit(rows)
