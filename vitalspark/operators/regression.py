"""Least-squares lines ``y = Slope * x + Intercept`` as Spark aggregates.

``regr_slope`` / ``regr_intercept`` are declarative aggregates with a partial
(map-side) step, so a fit over the whole table, or one per group, is a single
aggregation job however many rows or groups there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_COLUMNS = ("Slope", "Intercept", "N")


def fit_line(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    degenerate: str = "null",
) -> DataFrame:
    """Fit ``y`` on ``x`` over all rows (one row out) or per ``by`` group.

    Pairs with a NULL are skipped. ``N`` is the number of pairs used. For
    fewer than two distinct x values the slope is undefined: ``degenerate=
    "null"`` leaves Slope/Intercept NULL; ``"flat"`` returns slope 0 and the
    mean of y as intercept (the convention of common single-machine fitters).
    """
    if degenerate not in ("null", "flat"):
        raise ValueError("degenerate must be 'null' or 'flat'")
    aggs = [
        F.regr_slope(y, x).alias("Slope"),
        F.regr_intercept(y, x).alias("Intercept"),
        F.regr_count(y, x).alias("N"),
        F.regr_avgy(y, x).alias("_avg_y"),
    ]
    model = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if degenerate == "flat":
        has_pairs = F.col("N") > 0
        model = model.withColumns(
            {
                "Slope": F.when(has_pairs, F.coalesce("Slope", F.lit(0.0))),
                "Intercept": F.when(has_pairs, F.coalesce("Intercept", "_avg_y")),
            }
        )
    return model.select(*by, *MODEL_COLUMNS)


def predict_line(
    df: DataFrame,
    model: DataFrame,
    x: str,
    out: str = "Fitted",
    by: Sequence[str] = (),
    keep_model: bool = False,
) -> DataFrame:
    """Add ``out = Slope * x + Intercept``.

    A global model (one row) is read through one scalar subquery, which Spark
    runs once and inlines as a value; a grouped model is joined on ``by``.
    """
    if not by:
        # One subquery column; the projection below reads its fields (a
        # subquery is not inlined into several expressions).
        with_m = df.withColumn("_model", model.select(F.struct("Slope", "Intercept")).scalar())
        slope, intercept = F.col("_model.Slope"), F.col("_model.Intercept")
        extra = {"Slope": slope, "Intercept": intercept} if keep_model else {}
        return with_m.withColumns({**extra, out: F.col(x) * slope + intercept}).drop("_model")
    joined = df.join(model.select(*by, "Slope", "Intercept"), list(by), "left")
    joined = joined.withColumn(out, F.col(x) * F.col("Slope") + F.col("Intercept"))
    return joined if keep_model else joined.drop("Slope", "Intercept")


def fit_and_predict(df: DataFrame, x: str, y: str, out: str = "Fitted", degenerate: str = "null") -> DataFrame:
    """Global fit of ``y`` on ``x`` plus each row's fitted value, with the
    model's Slope and Intercept as columns."""
    model = fit_line(df, x, y, degenerate=degenerate)
    return predict_line(df, model, x, out=out, keep_model=True)
