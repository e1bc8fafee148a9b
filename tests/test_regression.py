import random

import numpy as np
import pytest

from vitalspark.operators import fit_and_predict, fit_line, predict_line


def test_global_fit_matches_numpy_and_residuals_sum_to_zero(spark):
    rnd = random.Random(3)
    pts = [(i, float(x), 3.0 * x - 7.0 + rnd.gauss(0, 5)) for i, x in enumerate(rnd.uniform(0, 100) for _ in range(500))]
    df = spark.createDataFrame(pts, "Id long, x double, y double")
    m = fit_line(df, "x", "y").collect()[0]
    slope, intercept = np.polyfit([p[1] for p in pts], [p[2] for p in pts], 1)
    assert m.N == 500
    assert m.Slope == pytest.approx(slope, rel=1e-9) and m.Intercept == pytest.approx(intercept, rel=1e-9)
    out = fit_and_predict(df, "x", "y").collect()
    assert sum(r.y - r.Fitted for r in out) == pytest.approx(0.0, abs=1e-6)
    assert {r.Slope for r in out} == {m.Slope}


def test_degenerate_fits(spark):
    df = spark.createDataFrame(
        [("const_x", 1.0, 2.0), ("const_x", 1.0, 4.0), ("one", 5.0, 1.0), ("const_y", 1.0, 3.0), ("const_y", 2.0, 3.0),
         ("nulls", None, 1.0), ("nulls", 1.0, None), ("nulls", 2.0, 2.0), ("nulls", 4.0, 6.0)],
        "g string, x double, y double",
    )
    null_mode = {r.g: (r.Slope, r.Intercept, r.N) for r in fit_line(df, "x", "y", by=["g"]).collect()}
    assert null_mode["const_x"] == (None, None, 2)
    assert null_mode["one"] == (None, None, 1)
    assert null_mode["const_y"] == (0.0, 3.0, 2)
    assert null_mode["nulls"] == (2.0, -2.0, 2)  # pairs with a NULL are skipped
    flat = {r.g: (r.Slope, r.Intercept) for r in fit_line(df, "x", "y", by=["g"], degenerate="flat").collect()}
    assert flat["const_x"] == (0.0, 3.0) and flat["one"] == (0.0, 1.0)
    with pytest.raises(ValueError):
        fit_line(df, "x", "y", degenerate="other")


def test_grouped_prediction(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 1.0), (1, 1.0, 3.0), (2, 0.0, 5.0), (2, 2.0, 1.0)], "Id long, x double, y double"
    )
    model = fit_line(df, "x", "y", by=["Id"])
    out = {(r.Id, r.x): r.Fitted for r in predict_line(df, model, "x", by=["Id"]).collect()}
    assert out == {(1, 0.0): 1.0, (1, 1.0): 3.0, (2, 0.0): 5.0, (2, 2.0): 1.0}


def test_global_prediction_uses_one_scalar_subquery(spark):
    df = spark.range(10).selectExpr("id AS Id", "CAST(id AS DOUBLE) AS x", "2.0 * id + 1 AS y")
    plan = fit_and_predict(df, "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") == 1
    assert "Join" not in plan
