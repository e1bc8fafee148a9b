"""Declared schemas of the nine tracker exports.

Types are fixed instead of inferred: inference costs an extra pass over every
file and its result depends on the file contents. Day and hour stamps that the
exports write as ``M/d/yyyy`` text are declared as strings and parsed by the
cleaning operators, which offer a lenient (NULL instead of failure) mode; the
operators also accept real date / timestamp columns (as Parquet sources have).
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, S, DT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DAILY_ACTIVITY = _st(
    ("Id", L),
    ("ActivityDate", S),
    ("TotalSteps", I),
    ("TotalDistance", D),
    ("TrackerDistance", D),
    ("LoggedActivitiesDistance", D),
    ("VeryActiveDistance", D),
    ("ModeratelyActiveDistance", D),
    ("LightActiveDistance", D),
    ("SedentaryActiveDistance", D),
    ("VeryActiveMinutes", I),
    ("FairlyActiveMinutes", I),
    ("LightlyActiveMinutes", I),
    ("SedentaryMinutes", I),
    ("Calories", I),
)

DAILY_CALORIES = _st(("Id", L), ("ActivityDay", S), ("Calories", I))

DAILY_HEARTRATE = _st(("Id", L), ("Day", DT), ("Mean_Value", D), ("Entry_Count", I))

DAILY_INTENSITIES = _st(
    ("Id", L),
    ("ActivityDay", S),
    ("SedentaryMinutes", I),
    ("LightlyActiveMinutes", I),
    ("FairlyActiveMinutes", I),
    ("VeryActiveMinutes", I),
    ("SedentaryActiveDistance", D),
    ("LightActiveDistance", D),
    ("ModeratelyActiveDistance", D),
    ("VeryActiveDistance", D),
)

DAILY_STEPS = _st(("Id", L), ("ActivityDay", S), ("StepTotal", I))

DAILY_SLEEP = _st(
    ("Id", L),
    ("SleepDay", S),
    ("TotalSleepRecords", I),
    ("TotalMinutesAsleep", I),
    ("TotalTimeInBed", I),
)

MINUTE_METS = _st(("Id", L), ("Activity", S), ("Minute", S), ("METs", I))

HOURLY_STEPS = _st(("Id", L), ("ActivityHour", S), ("StepTotal", I))

HOURLY_CALORIES = _st(("Id", L), ("ActivityHour", S), ("Calories", I))

# The raw event log the tracker tables can be derived from.
EVENTS = _st(
    ("event_id", L),
    ("ts", T.TimestampNTZType()),
    ("user_id", L),
    ("event_type", S),
    ("value", D),
    ("props", S),
)

SCHEMAS: dict[str, T.StructType] = {
    "daily_activity": DAILY_ACTIVITY,
    "daily_calories": DAILY_CALORIES,
    "daily_heartrate": DAILY_HEARTRATE,
    "daily_intensities": DAILY_INTENSITIES,
    "daily_steps": DAILY_STEPS,
    "daily_sleep": DAILY_SLEEP,
    "minute_mets": MINUTE_METS,
    "hourly_steps": HOURLY_STEPS,
    "hourly_calories": HOURLY_CALORIES,
}

# Columns the analyses need from each table (the rest are carried if present).
REQUIRED: dict[str, tuple[str, ...]] = {
    "daily_activity": (
        "Id", "ActivityDate", "TotalSteps", "TotalDistance", "VeryActiveDistance",
        "ModeratelyActiveDistance", "LightActiveDistance", "SedentaryActiveDistance",
        "VeryActiveMinutes", "FairlyActiveMinutes", "LightlyActiveMinutes",
        "SedentaryMinutes", "Calories",
    ),
    "daily_calories": ("Id", "ActivityDay", "Calories"),
    "daily_heartrate": ("Id", "Day", "Mean_Value"),
    "daily_intensities": ("Id", "ActivityDay"),
    "daily_steps": ("Id", "ActivityDay", "StepTotal"),
    "daily_sleep": ("Id", "SleepDay", "TotalMinutesAsleep", "TotalTimeInBed"),
    "minute_mets": ("Id", "Activity", "Minute", "METs"),
    "hourly_steps": ("Id", "ActivityHour", "StepTotal"),
    "hourly_calories": ("Id", "ActivityHour", "Calories"),
}
