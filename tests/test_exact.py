"""Exact averages: equal to rational arithmetic, whatever the order of rows."""

import math
import random
from fractions import Fraction
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from vitalspark.functions import exact_avg, exact_rounded_avg, exact_sum
from vitalspark.operators import average_by, daily_trend


def half_up(x: Fraction) -> int:
    n = math.floor(abs(x) + Fraction(1, 2))
    return n if x >= 0 else -n


def grouped(spark, groups):
    data = [(g, v) for g, vs in enumerate(groups) for v in vs]
    return spark.createDataFrame(data, "g int, v double").repartition(5)


def test_rounded_averages_are_exact(spark):
    rng = random.Random(11)
    groups = [[round(rng.uniform(-500, 500), rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(1, 60))] for _ in range(200)]
    # ties by construction: n values whose sum is (k + 1/2) n, in hundredths
    for n in (2, 3, 7, 40):
        vs = [round(rng.uniform(0, 100), 2) for _ in range(2 * n - 1)]
        missing = Fraction(2 * n * 101, 2) - sum(Fraction(repr(v)) for v in vs)
        groups.append([*vs, float(missing)])
    groups += [[0.1] * 10 + [0.95 * 10 - 1.0], [1e11, 0.5, -1e11, 0.5], [-2.5], [2.5], [-0.5, -0.5], [0.0]]
    got = grouped(spark, groups).groupBy("g").agg(exact_rounded_avg("v").alias("a"), exact_rounded_avg("v", 1000).alias("k"))
    for r in got.collect():
        exact = [Fraction(repr(v)) for v in groups[r["g"]]]
        mean = sum(exact) / len(exact)
        assert (r["a"], r["k"]) == (half_up(mean), half_up(1000 * mean)), groups[r["g"]]


def test_exact_average_is_the_nearest_double(spark):
    rng = random.Random(12)
    groups = [[round(rng.uniform(0, 300), 2) for _ in range(rng.randint(1, 200))] for _ in range(60)] + [[0.1] * 10, [1e11, 0.01, -1e11]]
    for order in (1, -1):
        df = grouped(spark, [g[::order] for g in groups])
        for r in df.groupBy("g").agg(exact_avg("v").alias("a"), exact_sum("v").alias("s")).collect():
            exact = [Fraction(repr(v)) for v in groups[r["g"]]]
            assert Fraction(str(r["s"])) == sum(exact)
            assert math.isclose(r["a"], float(sum(exact) / len(exact)), rel_tol=2.3e-16)
    assert reduce(add, [0.1] * 10) / 10 != 0.1  # what the plain sum gives
    assert df.where("g = 60").groupBy("g").agg(exact_avg("v").alias("a")).head()["a"] == 0.1


@pytest.mark.parametrize("bad", [math.nan, math.inf, 1e15])
def test_values_beyond_the_decimal_fall_back(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,), (None,)], "v double")
    r = df.agg(exact_sum("v").alias("s"), exact_avg("v").alias("a"), exact_rounded_avg("v").alias("q"), F.avg("v").alias("plain")).head()
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    rounded = 500000000000001.0 if bad == 1e15 else bad  # the average ends in .5
    assert r["s"] is None and same(r["a"], r["plain"]) and same(r["q"], rounded)


def test_nulls_empty_groups_and_integers(spark):
    df = spark.createDataFrame([(1, None, 10), (1, None, 11), (2, 0.25, None)], "g int, v double, n int")
    got = {r["g"]: (r["v"], r["n"], r["q"]) for r in df.groupBy("g").agg(exact_avg("v").alias("v"), exact_avg("n").alias("n"), exact_rounded_avg("n").alias("q")).collect()}
    assert got == {1: (None, 10.5, 11.0), 2: (0.25, None, None)}
    assert average_by(df.where("false"), ["g"], {"a": "v"}).count() == 0
    one = df.where("false").agg(exact_avg("v").alias("a"), exact_rounded_avg("v").alias("q")).head()
    assert one["a"] is None and one["q"] is None


def test_daily_trend_with_other_scales(spark):
    df = spark.createDataFrame([("d", 1, 0.00105, 1.0), ("d", 2, 0.00105, 2.0)], "Date string, TotalSteps int, TotalDistance double, Calories double")
    assert daily_trend(df, distance_scale=10**5).head()["avg_distance"] == 105.0
    assert daily_trend(df, distance_scale=0.5).head()["avg_distance"] == 0.0
    assert daily_trend(df).head()["avg_steps"] == 2.0
