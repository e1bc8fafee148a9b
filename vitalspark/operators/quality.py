"""Data-quality checks as one-pass aggregates (one job each, no driver loop)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: ``row_count`` and ``<col>_nulls`` for each column, in one scan."""
    cols = list(cols) if cols is not None else df.columns
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols],
    )


def duplicates(df: DataFrame, keys: Sequence[str], count_col: str = "Count") -> DataFrame:
    """Key groups that occur more than once, with their row count.

    A hot key costs nothing extra: the count is combined map-side before the
    shuffle, so each task ships one partial count per key.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count_col))
        .where(F.col(count_col) > 1)
    )


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many key groups occur more than once (``duplicate_groups``)
    and how many rows those groups hold (``duplicate_rows``)."""
    groups = duplicates(df, keys, "_count")
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("_count"), F.lit(0)).alias("duplicate_rows"),
    )
