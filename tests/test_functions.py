import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalspark.functions import (
    bucketize,
    hour_of_text,
    parse_date,
    parse_timestamp,
    quadrant,
    split_part,
    sum_columns,
    weekday_name,
    weekday_number,
)


def test_bucketize_edges_null_and_nan(spark):
    df = spark.createDataFrame(
        [(10.0,), (10.5,), (16.0,), (16.5,), (None,), (float("nan"),), (-3.0,)], "x double"
    )
    out = df.select("x", bucketize("x", [10, 16], ["Low", "Medium", "High"], "n/d").alias("b")).collect()
    got = {("nan" if r.x is not None and math.isnan(r.x) else r.x): r.b for r in out}
    assert got == {
        10.0: "Low",
        10.5: "Medium",
        16.0: "Medium",
        16.5: "High",
        None: "n/d",
        "nan": "High",
        -3.0: "Low",
    }


def test_bucketize_validates_arguments():
    with pytest.raises(ValueError):
        bucketize("x", [10, 16], ["a", "b"], "n/d")
    with pytest.raises(ValueError):
        bucketize("x", [16, 10], ["a", "b", "c"], "n/d")


def test_quadrant_cuts_are_inclusive_and_null_is_other(spark):
    df = spark.createDataFrame(
        [(10000.0, 420.0), (10000.0, 419.9), (9999.0, 420.0), (1.0, 1.0), (None, 500.0), (20000.0, None)],
        "a double, b double",
    )
    q = quadrant("a", 10000, "b", 420, "HH", "HL", "LH", "LL", "Other")
    assert [r.q for r in df.select(q.alias("q")).collect()] == ["HH", "HL", "LH", "LL", "Other", "Other"]


def test_sum_columns_is_null_if_any_input_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0)], "a double, b double, c double")
    assert [r.s for r in df.select(sum_columns("a", "b", "c").alias("s")).collect()] == [6.0, None]


def test_weekday_number_and_name(spark):
    df = spark.createDataFrame([(dt.date(2016, 4, 12),), (dt.date(2016, 4, 17),)], "d date")
    out = df.select(weekday_number("d").alias("n"), weekday_name("d").alias("w")).collect()
    assert [(r.n, r.w) for r in out] == [(3, "Tue"), (1, "Sun")]


def test_parse_date_strict_and_lenient(spark):
    df = spark.createDataFrame([("4/12/2016",), ("not a date",), ("",)], "s string")
    lenient = [r.d for r in df.select(parse_date("s", "M/d/yyyy", strict=False).alias("d")).collect()]
    assert lenient == [dt.date(2016, 4, 12), None, None]
    with pytest.raises(PySparkException):
        df.select(parse_date("s", "M/d/yyyy", strict=True)).collect()


def test_parse_timestamp_twelve_hour_clock(spark):
    df = spark.createDataFrame(
        [("4/12/2016 12:00:00 AM",), ("4/12/2016 12:00:00 PM",), ("4/12/2016 1:05:00 PM",), ("junk",)],
        "s string",
    )
    out = [r.t for r in df.select(parse_timestamp("s", "M/d/yyyy h:mm:ss a", strict=False).alias("t")).collect()]
    assert out == [
        dt.datetime(2016, 4, 12, 0, 0),
        dt.datetime(2016, 4, 12, 12, 0),
        dt.datetime(2016, 4, 12, 13, 5),
        None,
    ]
    with pytest.raises(PySparkException):
        df.select(parse_timestamp("s", "M/d/yyyy h:mm:ss a", strict=True)).collect()


def test_split_part_lenient_missing_part(spark):
    df = spark.createDataFrame([("a b",), ("one",)], "s string")
    assert [r.p for r in df.select(split_part("s", " ", 1, strict=False).alias("p")).collect()] == ["b", None]
    with pytest.raises(PySparkException):
        df.select(split_part("s", " ", 1, strict=True)).collect()


def test_hour_of_text(spark):
    df = spark.createDataFrame([("00:00",), ("08:00",), ("23:00",), (None,)], "h string")
    assert [r.h for r in df.select(hour_of_text("h").alias("h")).collect()] == [0, 8, 23, None]


@pytest.mark.parametrize("x", [1e29, -1e30, float("inf"), float("-inf")])
def test_round_half_up_keeps_large_values(spark, x):
    from vitalspark.functions.columns import round_half_up

    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(round_half_up(F.col("x"), 2)).head()[0] == x


def test_round_half_up_keeps_nan(spark):
    from vitalspark.functions.columns import round_half_up

    got = spark.createDataFrame([(float("nan"),)], "x double").select(round_half_up(F.col("x"), 2)).head()[0]
    assert got != got
