"""Grouped averages, totals, frequencies and shares.

All are hash aggregates with a map-side partial step, so a hot group key is
collapsed to one partial row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.constants import (
    DISTANCE_SCALE,
    INTENSITY_CUTS,
    INTENSITY_LABELS,
    INTENSITY_UNKNOWN,
)
from vitalspark.functions.classify import bucketize
from vitalspark.functions.columns import as_col, exact_avg, exact_rounded_avg, hour_of_text, round_half_up


def average_by(df: DataFrame, keys: Sequence, metrics: Mapping[str, "str | Column"]) -> DataFrame:
    """Average of each metric (output name -> input column) per key, from exact
    sums, so it does not depend on the order in which rows arrive."""
    return df.groupBy(*keys).agg(*[exact_avg(c).alias(out) for out, c in metrics.items()])


def totals_by(df: DataFrame, keys: Sequence, metrics: Mapping[str, "str | Column"]) -> DataFrame:
    """``sum`` of each metric (output name -> input column) per key."""
    return df.groupBy(*keys).agg(*[F.sum(as_col(c)).alias(out) for out, c in metrics.items()])


def rounded_avg(c, snap: bool = True) -> Column:
    """Average rounded half away from zero; ``c`` is a column name (averaged here)
    or an aggregate expression. With ``snap`` a column's average is rounded on the
    exact ratio of its exact sum and count (:func:`exact_rounded_avg`), and an
    expression by :func:`round_half_up`; without it, float noise (x.4999999999)
    may decide a .5 tie."""
    if isinstance(c, str):
        return exact_rounded_avg(c) if snap else F.round(F.avg(c))
    return round_half_up(c) if snap else F.round(c)


def weekday_average(activity: DataFrame) -> DataFrame:
    """Average steps, distance and calories per weekday."""
    return average_by(
        activity,
        ["WeekDayN", "WeekDay"],
        {"AvgSteps": "TotalSteps", "AvgDistance": "TotalDistance", "AvgCalories": "Calories"},
    )


def hour_of_day_average(hourly: DataFrame, metric: str = "Calories", out: str = "AvgCalories") -> DataFrame:
    """Average of ``metric`` per integer hour of day (0-23) of ``HH:mm`` text."""
    return hourly.groupBy(hour_of_text("Hour").alias("Hour")).agg(exact_avg(metric).alias(out))


def hour_text_average(hourly: DataFrame, metric: str = "Steps", out: str = "avg_steps") -> DataFrame:
    """Average of ``metric`` per ``HH:mm`` hour text."""
    return hourly.groupBy("Hour").agg(exact_avg(metric).alias(out))


def user_totals(activity: DataFrame) -> DataFrame:
    """Per-user totals of steps, active minutes and calories."""
    return totals_by(
        activity,
        ["Id"],
        {
            "TotalSteps": "TotalSteps",
            "TotalLightlyActiveMinutes": "LightlyActiveMinutes",
            "TotalFairlyActiveMinutes": "FairlyActiveMinutes",
            "TotalVeryActiveMinutes": "VeryActiveMinutes",
            "TotalCalories": "Calories",
        },
    )


def daily_trend(activity: DataFrame, distance_scale: float = DISTANCE_SCALE, snap: bool = True) -> DataFrame:
    """Per day: rounded average steps, distance (scaled) and calories; the scale
    is a whole number where the rounding is to be exact."""
    if snap and float(distance_scale).is_integer() and abs(distance_scale) < 10**6:
        distance = exact_rounded_avg("TotalDistance", int(distance_scale))
    else:
        distance = rounded_avg(F.avg("TotalDistance") * F.lit(distance_scale), snap)
    return activity.groupBy("Date").agg(
        rounded_avg("TotalSteps", snap).alias("avg_steps"),
        distance.alias("avg_distance"),
        rounded_avg("Calories", snap).alias("avg_calories"),
    )


def sleep_weekday_average(sleep: DataFrame, snap: bool = True) -> DataFrame:
    """Rounded average minutes asleep per weekday."""
    return sleep.groupBy("WeekDayN", "WeekDay").agg(
        rounded_avg("TotalMinutesAsleep", snap).alias("AvgSleepMinutes")
    )


def frequency(df: DataFrame, c: str, out: str = "Frequency") -> DataFrame:
    """Number of rows per distinct value of ``c``."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(out))


def share_of_total(
    df: DataFrame,
    label: str,
    metric: str,
    out_metric: str | None = None,
    share_col: str = "Share",
) -> DataFrame:
    """``sum(metric)`` per label and its fraction of the grand total.

    The total is a scalar subquery over the grouped result (computed once and
    inlined as a value), not a window over one partition.
    """
    out_metric = out_metric or metric
    grouped = df.groupBy(label).agg(F.sum(metric).alias(out_metric))
    total = grouped.select(F.sum(out_metric)).scalar()
    return grouped.withColumn(share_col, F.try_divide(F.col(out_metric), total))


def intensity_level(
    mets: DataFrame,
    cuts: Sequence[float] = INTENSITY_CUTS,
    labels: Sequence[str] = INTENSITY_LABELS,
    unknown: str = INTENSITY_UNKNOWN,
) -> DataFrame:
    """Per user: average METs rounded half-up, then classified on the rounded
    value (``<= 10`` Low, ``(10, 16]`` Medium, ``> 16`` High, NULL ``n/d``)."""
    return (
        mets.groupBy("Id")
        .agg(exact_rounded_avg("METs").alias("AvgMETs"))
        .withColumn("IntensityLevel", bucketize("AvgMETs", cuts, labels, unknown))
    )
