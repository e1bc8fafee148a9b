"""Moments of (x, y): stored rows add up to the fits of the pairs."""

import datetime as dt
import math
import random

import pytest

from vitalspark.operators import fit_line, fit_moments, merge_moments, middle, moment_table, repivot

from conftest import rows


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(4)
    data = []
    for user in range(20):
        for day in range(15):
            for _ in range(rng.randint(0, 4)):
                x = 70 + rng.gauss(0, 5)
                data.append((user, dt.date(2021, 3, 1 + day), x, 2000 + 30 * (x - 70) + rng.gauss(0, 20)))
    data += [(50, dt.date(2021, 3, 1), 0.1 * 3, float(k)) for k in range(6)]  # constant x
    data += [(51, dt.date(2021, 3, 1), 60.0, 1.0), (52, dt.date(2021, 3, 2), None, 1.0), (52, dt.date(2021, 3, 2), 1.0, None)]
    data += [(None, dt.date(2021, 3, 3), 61.0, 5.0), (None, dt.date(2021, 3, 4), 62.0, 7.0)]
    return spark.createDataFrame(data, "Id long, Day date, x double, y double").repartition(4)


def close(a, b):
    assert len(a) == len(b)
    for p, q in zip(a, b):
        for v, w in zip(p, q):
            assert v == w or (isinstance(v, float) and isinstance(w, float) and math.isclose(v, w, rel_tol=1e-8, abs_tol=1e-8)), (p, q)


@pytest.mark.parametrize("degenerate", ["null", "flat"])
@pytest.mark.parametrize("pivot", [(0.0, 0.0), (70.0, 2000.0)])
def test_every_level_from_one_table(spark, pairs, pivot, degenerate, tmp_path):
    moment_table(pairs, "x", "y", ["Id", "Day"], pivot).write.parquet(str(tmp_path / "m"))
    table = spark.read.parquet(str(tmp_path / "m"))
    for by in (["Id", "Day"], ["Id"], ["Day"], []):
        close(rows(fit_moments(table, by, degenerate)), rows(fit_line(pairs, "x", "y", by, degenerate)))


def test_days_are_appended_and_pivots_moved(spark, pairs, tmp_path):
    path = str(tmp_path / "m")
    old, new = pairs.where("Day < '2021-03-08'"), pairs.where("Day >= '2021-03-08'")
    at = middle(old, "x", "y")
    assert 60 < at[0] < 80
    moment_table(old, "x", "y", ["Id", "Day"], at).write.parquet(path)
    other = moment_table(new, "x", "y", ["Id", "Day"], middle(new, "x", "y"))
    # rows about two pivots do not add up, and say so
    mixed = merge_moments(spark.read.parquet(path).unionByName(other)).head()
    assert mixed["Sx"] is None and mixed["Sxy"] is None
    repivot(other, at).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    close(rows(fit_moments(table, ["Id"])), rows(fit_line(pairs, "x", "y", ["Id"])))
    close(rows(fit_moments(merge_moments(table, ["Id"]))), rows(fit_line(pairs, "x", "y")))


def test_a_pivot_keeps_digits_far_from_zero(spark):
    data = [(1e8 + k, 3.0 * k) for k in range(100)]
    df = spark.createDataFrame(data, "x double, y double")
    fit = fit_moments(moment_table(df, "x", "y", [], pivot=middle(df, "x", "y"))).head()
    assert math.isclose(fit["Slope"], 3.0, rel_tol=1e-9) and fit["N"] == 100


def test_empty_and_null_pairs(spark, pairs):
    empty = moment_table(pairs.where("false"), "x", "y", ["Id"])
    assert empty.count() == 0 and rows(fit_moments(empty)) == [(None, None, 0)] and middle(pairs.where("false"), "x", "y") == (0.0, 0.0)
    nulls = moment_table(pairs.where("Id = 52"), "x", "y", ["Id"])
    assert rows(fit_moments(nulls, ["Id"], "flat")) == [(52, None, None, 0)]
    with pytest.raises(ValueError):
        fit_moments(nulls, degenerate="other")
