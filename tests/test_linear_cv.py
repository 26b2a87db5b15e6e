"""Leave-one-fold-out statistics give the scores of refitting every fold."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression

from tabsense.operators import models as MD


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 900
    x, z = rng.normal(50, 9, n), rng.exponential(3, n)
    city = rng.choice(["a", "b", "b", "c"], n)
    y = 1000 + 3 * x - 7 * z + np.select([city == "a", city == "b"], [20, -10], 5) + rng.normal(0, 4, n)
    pdf = pd.DataFrame({"id": range(n), "x": np.where(rng.random(n) < 0.1, np.nan, x), "z": z, "const": 3.0,
                        "city": np.where(rng.random(n) < 0.08, None, city), "label": y})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("reg", [0.0, 0.5, 40.0])
def test_equal_to_refitting(table, monkeypatch, reg):
    est = LinearRegression(elasticNetParam=0.0, standardization=False, regParam=reg)
    args = (est, table, ["id"], 4, "regression", ["x", "z", "const"], ["city"], "standard")
    fast = MD.cv_score(*args)
    monkeypatch.setattr(MD, "_by_normal_equations", lambda *a: False)
    assert abs(fast - MD.cv_score(*args)) < 1e-6 and 0.1 < fast < 1


def test_only_numbers_or_only_categories(table):
    est = LinearRegression(elasticNetParam=0.0, standardization=False, regParam=1.0)
    assert 0.3 < MD.cv_score(est, table, ["id"], 3, "regression", ["x", "z"], [], "standard") < 1
    assert -0.1 < MD.cv_score(est, table, ["id"], 3, "regression", [], ["city"], "standard") < 0.5


def test_too_many_categories_fall_back(table, monkeypatch):
    from tabsense.operators import linear_cv as L

    monkeypatch.setattr(L, "MAX_FEATURES", 3)
    assert L.linear_cv_scores(table, ["id"], 3, ["x"], ["city"], 1.0, 42) is None


def test_cv_failure_is_recorded(spark, monkeypatch):
    df = spark.range(60).selectExpr("id * 1.0 AS x", "id * 2.0 + 1 AS y")
    monkeypatch.setattr(MD, "cv_score", lambda *a: 1 / 0)
    res = MD.train_supervised(df, "y", algorithm="linear_regression", cv_folds=3)
    assert "ZeroDivisionError" in res.cv_error and "cv_mean_score" not in res.metrics
