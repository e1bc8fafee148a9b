"""Least-squares lines from stored, mergeable moments.

``moment_table`` reduces (x, y) pairs to one row a group: the number of pairs, the
sums of x, y, x*x, x*y taken about a pivot, and the range of x. Rows add up, so any
coarser grouping is fitted from the table instead of the pairs: per user and
day, per user, per day and over all from one pass, and new days are appended as
new rows.

The pivot is a point near the data's middle (the same for a whole table); sums about
it lose far fewer digits than sums about zero. Rows about another pivot are
moved to the first one's by :func:`repivot` before they are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.operators.regression import MODEL_COLUMNS

MOMENTS = ("N", "Sx", "Sy", "Sxx", "Sxy", "MinX", "MaxX", "PivotX", "PivotY")


def _sums() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in ("N", "Sx", "Sy", "Sxx", "Sxy")]
    pivots = [F.first(c, ignorenulls=True).alias(c) for c in ("PivotX", "PivotY")]
    return [*sums, F.min("MinX").alias("MinX"), F.max("MaxX").alias("MaxX"), *pivots]


def moment_table(df: DataFrame, x: str, y: str, by: Sequence[str], pivot: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row per ``by`` group with the moments of its (x, y) pairs; pairs with a
    NULL count for nothing (a group of such pairs has N = 0)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    own = F.when(both, F.col(x).cast("double"))
    dx, dy = own - F.lit(float(pivot[0])), F.when(both, F.col(y).cast("double")) - F.lit(float(pivot[1]))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count_if(both).alias("N"),
        zero(dx).alias("Sx"),
        zero(dy).alias("Sy"),
        zero(dx * dx).alias("Sxx"),
        zero(dx * dy).alias("Sxy"),
        F.min(own).alias("MinX"),
        F.max(own).alias("MaxX"),
        F.lit(float(pivot[0])).alias("PivotX"),
        F.lit(float(pivot[1])).alias("PivotY"),
    )


def middle(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """A pivot for ``df``: the means of x and y over complete pairs, (0, 0) if
    there are none."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    row = both.agg(F.avg(x).alias("x"), F.avg(y).alias("y")).head()
    return (float(row["x"] or 0.0), float(row["y"] or 0.0))


def repivot(moments: DataFrame, pivot: tuple[float, float]) -> DataFrame:
    """The same moments about another pivot."""
    a, b = F.col("PivotX") - F.lit(float(pivot[0])), F.col("PivotY") - F.lit(float(pivot[1]))
    n, sx, sy = F.col("N"), F.col("Sx"), F.col("Sy")
    moved = {
        "Sx": sx + n * a,
        "Sy": sy + n * b,
        "Sxx": F.col("Sxx") + 2 * a * sx + n * a * a,
        "Sxy": F.col("Sxy") + b * sx + a * sy + n * a * b,
        "PivotX": F.lit(float(pivot[0])),
        "PivotY": F.lit(float(pivot[1])),
    }
    return moments.select(*[moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in moments.columns])


def merge_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the coarser groups ``by`` (none: of everything, one row). All
    rows must be about one pivot; rows about several give NULL sums."""
    one = F.when((F.min("PivotX") == F.max("PivotX")) & (F.min("PivotY") == F.max("PivotY")), F.lit(True))
    grouped = moments.groupBy(*by).agg(*_sums(), one.alias("_one"))
    sums = {c: F.when(F.col("_one"), F.col(c)).alias(c) for c in ("Sx", "Sy", "Sxx", "Sxy")}
    return grouped.select(*by, *[sums.get(c, F.col(c)) for c in MOMENTS])


def fit_moments(moments: DataFrame, by: Sequence[str] = (), degenerate: str = "null") -> DataFrame:
    """``by``, Slope, Intercept and N of the line of each group: what ``fit_line``
    gives on the pairs themselves, with the same cases (``degenerate``)."""
    if degenerate not in ("null", "flat"):
        raise ValueError("degenerate must be 'null' or 'flat'")
    m = merge_moments(moments, by)
    n = F.col("N")
    xx = F.col("Sxx") - F.try_divide(F.col("Sx") * F.col("Sx"), n)
    xy = F.col("Sxy") - F.try_divide(F.col("Sx") * F.col("Sy"), n)
    slope = F.when(F.col("MinX") < F.col("MaxX"), F.try_divide(xy, xx))
    mean_x, mean_y = F.col("PivotX") + F.try_divide(F.col("Sx"), n), F.col("PivotY") + F.try_divide(F.col("Sy"), n)
    out = m.withColumn("Slope", slope)
    intercept = mean_y - F.col("Slope") * mean_x
    if degenerate == "flat":
        some = F.col("N") > 0
        out = out.withColumn("Slope", F.when(some, F.coalesce("Slope", F.lit(0.0))))
        intercept = F.when(some, F.coalesce(intercept, mean_y))
    return out.withColumn("Intercept", intercept).withColumn("N", F.coalesce("N", F.lit(0))).select(*by, *MODEL_COLUMNS)
