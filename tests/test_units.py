"""Unit checks for the SURVEY section 2 rows whose check is a unit test:
chart names and axes (V13, V14), training guards (T3), the saved preprocessing
pipeline (T12, S13), expanded feature names (X3), models of a dataset (R10) and
step isolation (H3)."""
import datetime as dt

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabsense.operators import catalog as R
from tabsense.operators import charts as C
from tabsense.operators import models as MD
from tabsense.operators import prep as P
from tabsense.plans import report as H


def test_chart_aliases_and_unknown_kind():
    assert C.chart_kind("scatter") == "scatter_plot"
    assert C.chart_kind("Box") == "box_plot"
    assert C.chart_kind("correlation_matrix") == "heatmap"
    assert C.chart_kind("distribution") == "distribution_plot"
    with pytest.raises(ValueError):
        C.chart_kind("radar")


def test_default_axes(unit_df):
    x, y, hue = C.default_axes(unit_df, "scatter")
    assert (x, y, hue) == ("yosh", "daromad", None)
    assert C.default_axes(unit_df, "histogram")[0] == "yosh"
    assert C.default_axes(unit_df, "heatmap")[0] is None
    with pytest.raises(ValueError):
        C.default_axes(unit_df, "histogram", x="nope")


def test_training_guards(spark, unit_df):
    P.check_training_input(unit_df, "sotib_oldi")
    with pytest.raises(ValueError):
        P.check_training_input(unit_df, "missing_col")
    with pytest.raises(ValueError):
        P.check_training_input(unit_df.withColumn("one", F.lit(1)), "one")
    with pytest.raises(ValueError):
        P.check_training_input(unit_df.limit(10), "sotib_oldi")


def test_saved_pipeline_reproduces_predictions_and_names(spark, unit_df, tmp_path):
    res = MD.train_supervised(unit_df.drop("rid"), "sotib_oldi", algorithm="logistic_regression",
                              cv_folds=0, key_cols=["yosh", "daromad", "shahar"])
    # Numeric names first, then one-hot names as col_value
    assert res.feature_names[:2] == ["yosh", "daromad"]
    assert any(n.startswith("shahar_") for n in res.feature_names)
    path = MD.save_model(res, str(tmp_path / "model"))
    loaded = PipelineModel.load(path)
    data = unit_df.drop("rid").where(F.col("sotib_oldi").isNotNull())
    again = loaded.transform(data).select("prediction").collect()
    assert len(again) == data.count()


def test_models_of_dataset_newest_first(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"m{i}", "s1", "d1" if i < 7 else "d2", "classification", "random_forest", "y", ["a"],
             {"accuracy": 0.5 + i / 100}, f"/m{i}", t0 + dt.timedelta(seconds=i)) for i in range(9)]
    models = spark.createDataFrame(rows, R.MODELS)
    got = R.models_of_dataset(models, "d1").collect()
    assert [r["id"] for r in got] == ["m6", "m5", "m4", "m3", "m2"]
    assert abs(got[0]["accuracy"] - 0.56) < 1e-12
    assert got[0]["r2"] is None


def test_failed_step_does_not_stop_the_rest(unit_df):
    ctx = H.StepContext(unit_df.drop("rid"))
    status, outputs = H.run_steps(ctx, [
        {"tool": "chart", "args": {"chart_type": "radar"}},
        {"tool": "nope", "args": {}},
        {"tool": "outliers", "args": {"method": "z-score"}},
    ])
    rows = status.orderBy("step").collect()
    assert [r["success"] for r in rows] == [False, False, True]
    assert "unknown" in rows[1]["error"]
    assert outputs[2]["result"]


def test_grid_search_picks_a_grid_point(unit_df):
    """Tuning runs the reference's depth grid for a decision tree with 3 folds."""
    res = MD.train_supervised(unit_df.drop("rid"), "sotib_oldi", algorithm="decision_tree",
                              cv_folds=0, tuning=True, key_cols=["yosh", "daromad", "shahar"])
    assert res.model.getOrDefault("maxDepth") in (3, 5, 8)
    assert 0.0 <= res.metrics["accuracy"] <= 1.0


def test_fold_medians_equal_per_fold_medians(spark, unit_df):
    df = P.with_folds(unit_df, ["rid"], 4)
    cols = ["yosh", "daromad"]
    allf = P.fold_medians(df, cols, 4)
    for i in range(4):
        assert allf[i] == P.medians(df.where(F.col("fold") != i), cols)
