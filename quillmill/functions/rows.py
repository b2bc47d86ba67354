"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unroll(df: DataFrame, keep: list, array: Column | str, value: str = "value", pos: str | None = None) -> DataFrame:
    """One row per array element, without rows for empty arrays.

    A plain explode makes the optimizer add a filter on the array's size and
    push it below, so an array that is costly to compute would be computed
    twice (and once more per stage of a chain).  The outer form is left alone,
    and the missing positions are dropped after it.
    """
    at = pos or "_at"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)


def unroll_fields(df: DataFrame, keep: list[str], array: Column | str) -> DataFrame:
    """One row per struct in the array, its fields as columns."""
    return unroll(df, keep, array, "_row").select(*keep, "_row.*")
