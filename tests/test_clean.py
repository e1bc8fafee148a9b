import datetime as dt

import pytest
from pyspark.sql import types as T

from vitalspark.operators import (
    activity_clean,
    hourly_split,
    intensities_clean,
    mets_clean,
    rename_columns,
    sleep_clean,
)
from vitalspark.operators.clean import ACTIVITY_CLEAN_COLUMNS
from vitalspark.sources.schemas import DAILY_ACTIVITY, DAILY_SLEEP, HOURLY_STEPS, MINUTE_METS

from conftest import rows


def _activity_row(i, day, steps, dists, cal=2000):
    very, mod, light, sed = dists
    return (i, day, steps, 5.0, 5.0, 0.0, very, mod, light, sed, 10, 20, 30, 1000, cal)


def test_activity_clean_filters_zero_and_null_distance(spark):
    data = [
        _activity_row(1, "4/12/2016", 100, (1.0, 1.0, 1.0, 1.0)),
        _activity_row(1, "4/13/2016", 0, (0.0, 0.0, 0.0, 0.0)),  # zero -> dropped
        _activity_row(2, "4/12/2016", 50, (None, 1.0, 1.0, 1.0)),  # NULL sum -> dropped
        _activity_row(3, "4/17/2016", 70, (0.0, 0.0, 0.5, 0.0)),
    ]
    out = activity_clean(spark.createDataFrame(data, DAILY_ACTIVITY))
    assert tuple(out.columns) == ACTIVITY_CLEAN_COLUMNS
    got = rows(out, "Id", "Date", "WeekDayN", "WeekDay", "SumOfDistances")
    assert got == [(1, dt.date(2016, 4, 12), 3, "Tue", 4.0), (3, dt.date(2016, 4, 17), 1, "Sun", 0.5)]


def test_activity_clean_accepts_date_column(spark):
    schema = T.StructType(
        [T.StructField(f.name, T.DateType() if f.name == "ActivityDate" else f.dataType) for f in DAILY_ACTIVITY]
    )
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 3, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1, 0, 0, 0, 9)], schema
    )
    out = activity_clean(df).collect()
    assert out[0]["Date"] == dt.date(2024, 1, 1) and out[0]["WeekDay"] == "Mon"


def test_activity_clean_lenient_bad_dates_become_null(spark):
    data = [_activity_row(1, "garbage", 100, (1.0, 0.0, 0.0, 0.0))]
    out = activity_clean(spark.createDataFrame(data, DAILY_ACTIVITY), strict=False).collect()
    assert out[0]["Date"] is None and out[0]["WeekDayN"] is None


def test_sleep_clean_keeps_duplicates_unless_asked(spark):
    data = [
        (1, "2/28/2021 12:00:00 AM", 1, 100, 120),
        (1, "2/28/2021 12:00:00 AM", 1, 100, 120),
        (2, "3/1/2021 12:00:00 AM", 2, 90, 95),
    ]
    df = spark.createDataFrame(data, DAILY_SLEEP)
    out = sleep_clean(df)
    assert out.columns == ["Id", "Date", "TotalMinutesAsleep", "TotalTimeInBed", "WeekDayN", "WeekDay"]
    assert out.count() == 3
    assert sleep_clean(df, dedupe=True).count() == 2
    assert rows(out, "Id", "Date", "WeekDay")[-1] == (2, dt.date(2021, 3, 1), "Mon")


def test_rename_columns_strict_and_lenient(spark):
    df = spark.createDataFrame([(1, "x")], "Id long, Activity string")
    with pytest.raises(ValueError):
        rename_columns(df, {"Missing": "Other"})
    assert rename_columns(df, {"Missing": "Other"}, strict=False).columns == ["Id", "Activity"]
    assert rename_columns(df, {"Activity": "Date"}).columns == ["Id", "Date"]


def test_mets_clean_renames(spark):
    df = spark.createDataFrame([(1, "4/12/2016", "00:01", 10)], MINUTE_METS)
    assert mets_clean(df).columns == ["Id", "Date", "Time", "METs"]
    with pytest.raises(ValueError):
        mets_clean(df.drop("Minute"))


def test_hourly_split_formats_day_and_hour(spark):
    df = spark.createDataFrame(
        [(1, "4/12/2016 12:00:00 AM", 5), (1, "4/12/2016 1:00:00 PM", 7), (2, "10/2/2016 11:00:00 PM", 1)],
        HOURLY_STEPS,
    )
    out = hourly_split(df, "StepTotal", "Steps")
    assert out.columns == ["Id", "Day", "Hour", "Steps"]
    assert rows(out) == [(1, "4/12/2016", "00:00", 5), (1, "4/12/2016", "13:00", 7), (2, "10/2/2016", "23:00", 1)]


def test_intensities_clean_renames_day(spark):
    df = spark.createDataFrame([(1, "4/12/2016", 5)], "Id long, ActivityDay string, SedentaryMinutes int")
    assert intensities_clean(df).columns == ["Id", "Date", "SedentaryMinutes"]


def test_empty_inputs(spark):
    empty_act = spark.createDataFrame([], DAILY_ACTIVITY)
    empty_sleep = spark.createDataFrame([], DAILY_SLEEP)
    assert activity_clean(empty_act).count() == 0
    assert sleep_clean(empty_sleep).count() == 0


def test_hourly_split_accepts_timestamps(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2016, 4, 12, 13, 0), 7)], "Id long, ActivityHour timestamp_ntz, StepTotal int"
    )
    assert rows(hourly_split(df, "StepTotal", "Steps")) == [(1, "4/12/2016", "13:00", 7)]
