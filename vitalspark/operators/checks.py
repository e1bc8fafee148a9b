"""Quality checks gathered while a table is written.

``write_checked`` writes a table once and returns, with it, its numbers of rows,
of NULLs a column and of repeated rows. The counts are metrics that Spark observes
on rows as they pass to the writer (``DataFrame.observe``), so nothing is read a
second time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CheckedTable:
    """A written table and what was counted on the way."""

    path: str
    row_count: int
    nulls: dict[str, int]
    duplicate_groups: int | None = None
    duplicate_rows: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: ``row_count``, ``<column>_nulls``, and the duplicates if they
        were counted."""
        values = {"row_count": self.row_count, **{f"{c}_nulls": n for c, n in self.nulls.items()}}
        if self.duplicate_groups is not None:
            values |= {"duplicate_groups": self.duplicate_groups, "duplicate_rows": self.duplicate_rows}
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{c}` long" for c in values))


def _metrics(observed: Observation) -> dict | None:
    """The metrics, None if Spark reported none for the write."""
    try:
        return observed.get
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "AssertionError":
            return None
        raise


def write_checked(
    df: DataFrame,
    path: str,
    keys: Sequence[str] | None = None,
    copies: str | None = None,
    mode: str = "errorifexists",
) -> CheckedTable:
    """Write ``df`` to Parquet and count rows and NULLs on the way.

    With ``copies`` the table is written with one row per distinct row and its
    number of copies in that column (a lossless form: no row is forgotten), and
    repeated rows are counted too; with ``keys`` one row per distinct key, with
    the number of its rows, and repeated keys are counted. Grouping has a partial
    step in every task, so a row that is a third of the table travels as one row a
    task, and the duplicates need no second pass.
    """
    if keys is not None and copies is None:
        raise ValueError("keys need the name of the copies column")
    if copies is not None and copies in df.columns:
        raise ValueError(f"the table has a column {copies!r} already")
    seen = Observation()
    nulls = {c: F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)}
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls.values())
    repeated = None
    if copies is not None:
        by = [F.col(f"`{c}`") for c in (keys if keys is not None else df.columns)]
        again = F.col(copies) > 1
        repeated = Observation()
        out = out.groupBy(*by).agg(F.count(F.lit(1)).alias(copies)).observe(
            repeated, F.count_if(again).alias("groups"), F.coalesce(F.sum(F.when(again, F.col(copies))), F.lit(0)).alias("rows")
        )
    out.write.mode(mode).parquet(path)
    got = _metrics(seen)
    dup = {} if repeated is None else _metrics(repeated)
    if got is None or dup is None:
        # the optimizer leaves the metrics out where it finds a table to be empty
        if not df.sparkSession.read.parquet(path).isEmpty():
            raise RuntimeError(f"{path} was written without its metrics")
        zero = None if repeated is None else 0
        return CheckedTable(path, 0, dict.fromkeys(df.columns, 0), zero, zero)
    return CheckedTable(
        path, got["rows"], {c: got[f"n{i}"] for i, c in enumerate(df.columns)}, dup.get("groups"), dup.get("rows")
    )
