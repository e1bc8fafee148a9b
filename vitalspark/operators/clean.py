"""Cleaning steps: renames, derived weekday columns, day / hour parsing.

None of these sort: ordering is a presentation step left to the caller.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.constants import DAY_FORMAT, HOUR_STAMP_FORMAT, HOUR_TEXT_FORMAT
from vitalspark.functions.columns import (
    parse_timestamp,
    split_part,
    sum_columns,
    to_day,
    weekday_name,
    weekday_number,
)

DISTANCE_PARTS = (
    "VeryActiveDistance",
    "ModeratelyActiveDistance",
    "LightActiveDistance",
    "SedentaryActiveDistance",
)

ACTIVITY_CLEAN_COLUMNS = (
    "Id",
    "Date",
    "TotalSteps",
    "TotalDistance",
    "SedentaryActiveDistance",
    "LightActiveDistance",
    "ModeratelyActiveDistance",
    "VeryActiveDistance",
    "SedentaryMinutes",
    "LightlyActiveMinutes",
    "FairlyActiveMinutes",
    "VeryActiveMinutes",
    "Calories",
    "WeekDay",
    "WeekDayN",
    "SumOfDistances",
)


def rename_columns(df: DataFrame, mapping: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Rename columns. Unlike ``withColumnRenamed``, a missing source column is
    an error unless ``strict=False`` (then it is skipped)."""
    missing = [c for c in mapping if c not in df.columns]
    if missing and strict:
        raise ValueError(f"cannot rename missing columns {missing}; have {df.columns}")
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def add_weekday(df: DataFrame, day_col: str = "Date") -> DataFrame:
    """Add ``WeekDayN`` (1 = Sunday) and ``WeekDay`` (``Sun`` ... ``Sat``)."""
    return df.withColumns({"WeekDayN": weekday_number(day_col), "WeekDay": weekday_name(day_col)})


def activity_clean(
    daily_activity: DataFrame,
    date_format: str | None = None,
    strict: bool = True,
    min_distance: float = 0.0,
) -> DataFrame:
    """Daily activity, cleaned: ``ActivityDate`` -> ``Date`` (parsed when it is
    text, in any form of :func:`day_of_text` or in the one of ``date_format``),
    ``TotalSteps`` as int, weekday columns, ``SumOfDistances`` = the four
    intensity distances, and only rows with ``SumOfDistances > min_distance``
    (a NULL sum is dropped too)."""
    day = to_day("ActivityDate", date_format, strict, _dtype(daily_activity, "ActivityDate"))
    return (
        daily_activity.select(
            "Id",
            day.alias("Date"),
            F.col("TotalSteps").cast("int").alias("TotalSteps"),
            "TotalDistance",
            "SedentaryActiveDistance",
            "LightActiveDistance",
            "ModeratelyActiveDistance",
            "VeryActiveDistance",
            "SedentaryMinutes",
            "LightlyActiveMinutes",
            "FairlyActiveMinutes",
            "VeryActiveMinutes",
            "Calories",
            weekday_name(day).alias("WeekDay"),
            weekday_number(day).alias("WeekDayN"),
            sum_columns(*DISTANCE_PARTS).alias("SumOfDistances"),
        )
        .where(F.col("SumOfDistances") > F.lit(min_distance))
    )


def sleep_clean(
    daily_sleep: DataFrame,
    date_format: str | None = None,
    strict: bool = True,
    dedupe: bool = False,
) -> DataFrame:
    """Daily sleep, cleaned: the day part of ``SleepDay`` -> ``Date``, weekday
    columns, ``TotalSleepRecords`` dropped. Exact duplicate rows are kept (they
    count twice downstream) unless ``dedupe=True``."""
    dtype = _dtype(daily_sleep, "SleepDay")
    if isinstance(dtype, T.StringType) and date_format is not None:
        day = to_day(split_part("SleepDay", " ", 0, strict), date_format, strict)
    else:
        day = to_day("SleepDay", date_format, strict, dtype)
    out = (
        daily_sleep.withColumn("SleepDay", day)
        .transform(lambda d: add_weekday(d, "SleepDay"))
        .drop("TotalSleepRecords")
        .withColumnRenamed("SleepDay", "Date")
    )
    return out.dropDuplicates() if dedupe else out


def mets_clean(minute_mets: DataFrame) -> DataFrame:
    """Minute METs with ``Activity`` -> ``Date`` and ``Minute`` -> ``Time``."""
    return rename_columns(minute_mets, {"Activity": "Date", "Minute": "Time"})


def hourly_split(
    hourly: DataFrame,
    metric: str,
    out_metric: str | None = None,
    stamp_col: str = "ActivityHour",
    stamp_format: str = HOUR_STAMP_FORMAT,
    strict: bool = True,
) -> DataFrame:
    """Hourly table -> ``Id, Day, Hour, <metric>`` where ``Day`` is ``M/d/yyyy``
    text and ``Hour`` is ``HH:mm`` text of the parsed 12-hour stamp (a stamp
    that is already a timestamp is used as it is)."""
    dtype = _dtype(hourly, stamp_col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        ts = F.col(stamp_col)
    else:
        ts = parse_timestamp(stamp_col, stamp_format, strict)
    return hourly.select(
        "Id",
        F.date_format(ts, DAY_FORMAT).alias("Day"),
        F.date_format(ts, HOUR_TEXT_FORMAT).alias("Hour"),
        F.col(metric).alias(out_metric or metric),
    )


def intensities_clean(daily_intensities: DataFrame) -> DataFrame:
    """Daily intensities with ``ActivityDay`` -> ``Date`` (kept as written)."""
    return rename_columns(daily_intensities, {"ActivityDay": "Date"})


def distinct_users(df: DataFrame, key: str = "Id") -> DataFrame:
    return df.select(key).distinct()
