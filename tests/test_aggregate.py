import datetime as dt

import pytest

from vitalspark.operators import (
    daily_trend,
    duplicates,
    frequency,
    hour_of_day_average,
    intensity_level,
    null_counts,
    share_of_total,
    sleep_weekday_average,
    user_totals,
    weekday_average,
)

from conftest import rows


def test_null_counts_one_pass(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (None, None)], "Id long, s string")
    r = null_counts(df).collect()
    assert len(r) == 1 and r[0].asDict() == {"row_count": 3, "Id_nulls": 2, "s_nulls": 2}


def test_duplicates_returns_repeated_keys_only(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "a")], "k long, v string")
    assert rows(duplicates(df, ["k", "v"])) == [(1, "a", 2), (2, "a", 3)]
    assert duplicates(df.limit(0), ["k"]).count() == 0


def _activity(spark, data):
    return spark.createDataFrame(
        data,
        "Id long, Date date, TotalSteps int, TotalDistance double, Calories double, WeekDayN int, WeekDay string,"
        " LightlyActiveMinutes int, FairlyActiveMinutes int, VeryActiveMinutes int",
    )


def test_weekday_average_and_user_totals(spark):
    d1, d2 = dt.date(2016, 4, 12), dt.date(2016, 4, 13)
    df = _activity(
        spark,
        [
            (1, d1, 100, 1.0, 10.0, 3, "Tue", 1, 2, 3),
            (2, d1, 300, 3.0, 30.0, 3, "Tue", 1, 1, 1),
            (1, d2, 50, 0.5, 5.0, 4, "Wed", 0, 0, 0),
        ],
    )
    assert rows(weekday_average(df)) == [(3, "Tue", 200.0, 2.0, 20.0), (4, "Wed", 50.0, 0.5, 5.0)]
    assert rows(user_totals(df)) == [(1, 150, 1, 2, 3, 15.0), (2, 300, 1, 1, 1, 30.0)]


def test_daily_trend_rounds_half_up_after_snapping(spark):
    d = dt.date(2016, 4, 12)
    # avg distance = 0.1005 km -> 100.5 m: float noise gives 100.49999999999999,
    # snapping to 6 decimals first restores the exact half that rounds up.
    df = _activity(spark, [(1, d, 1, 0.1005, 2.5, 3, "Tue", 0, 0, 0), (2, d, 2, 0.1005, 3.5, 3, "Tue", 0, 0, 0)])
    r = daily_trend(df).collect()[0]
    assert (r.avg_steps, r.avg_distance, r.avg_calories) == (2.0, 101.0, 3.0)


def test_sleep_weekday_average(spark):
    df = spark.createDataFrame(
        [(1, 3, "Tue", 400.0), (2, 3, "Tue", 401.0), (3, 1, "Sun", 453.0)],
        "Id long, WeekDayN int, WeekDay string, TotalMinutesAsleep double",
    )
    assert rows(sleep_weekday_average(df)) == [(1, "Sun", 453.0), (3, "Tue", 401.0)]


def test_frequency_sums_to_row_count(spark):
    df = spark.range(1000).selectExpr("id % 7 AS METs")
    f = frequency(df, "METs")
    assert sum(r.Frequency for r in f.collect()) == 1000 and f.count() == 7


def test_share_of_total_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), (None, 2.0)], "l string, m double")
    out = {r.l: (r.m, r.Share) for r in share_of_total(df, "l", "m").collect()}
    assert out == {"a": (4.0, 0.4), "b": (4.0, 0.4), None: (2.0, 0.2)}
    assert share_of_total(df.limit(0), "l", "m").count() == 0


def test_intensity_level_classifies_the_rounded_average(spark):
    data = [(1, 10), (1, 11), (2, 16), (2, 17), (3, 10), (4, 3), (5, None)]
    df = spark.createDataFrame(data, "Id long, METs int")
    out = {r.Id: (r.AvgMETs, r.IntensityLevel) for r in intensity_level(df).collect()}
    # user 1: avg 10.5 rounds to 11 -> Medium; user 2: 16.5 -> 17 -> High
    assert out == {1: (11.0, "Medium"), 2: (17.0, "High"), 3: (10.0, "Low"), 4: (3.0, "Low"), 5: (None, "n/d")}


def test_hour_of_day_average(spark):
    df = spark.createDataFrame([("08:00", 10.0), ("08:00", 20.0), ("13:00", 5.0)], "Hour string, Calories double")
    assert rows(hour_of_day_average(df)) == [(8, 15.0), (13, 5.0)]


@pytest.mark.parametrize("fn", [weekday_average, user_totals])
def test_no_python_in_plans(spark, fn):
    df = _activity(spark, [(1, dt.date(2016, 4, 12), 1, 1.0, 1.0, 3, "Tue", 0, 0, 0)])
    plan = fn(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
