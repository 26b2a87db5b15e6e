from pyspark.sql import functions as F

from tabsense.operators import explain as X
from tabsense.operators import models as MD
from tabsense.operators import prep as P


def test_task_type(unit_df):
    assert P.task_type(unit_df, "sotib_oldi") == "classification"
    assert P.task_type(unit_df, "daromad") == "regression"
    assert P.task_type(unit_df, "shahar") == "classification"


def test_feature_select_drops_ids(spark):
    df = spark.range(100).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("cid"),
                                 (F.col("id") % 7).alias("x"), (F.col("id") % 2).alias("y"))
    keep, dropped = P.feature_select(df, "y")
    assert keep == ["x"] and dropped == ["cid"]


def test_classification_accuracy_and_importance(unit_df):
    df = unit_df.drop("rid")
    res = MD.train_supervised(df, "sotib_oldi", algorithm="random_forest", cv_folds=0)
    assert res.task_type == "classification"
    assert res.metrics["accuracy"] > 0.8
    nat = X.native_importance(res)
    assert nat is not None and nat.count() > 0


def test_regression_ridge(unit_df):
    df = unit_df.drop("rid").where(~F.isnan("daromad"))
    res = MD.train_supervised(df, "daromad", algorithm="ridge", cv_folds=3)
    assert res.task_type == "regression" and "r2" in res.metrics and "cv_mean_score" in res.metrics


def test_unknown_algorithm_falls_back(unit_df):
    est, used = MD.make_estimator("classification", "nonsense", 100)
    assert used == "random_forest"


def test_kmeans_silhouette_positive(unit_df):
    res, labelled = MD.train_clustering(unit_df, ["yosh", "daromad"], "kmeans", 3)
    assert res.metrics["silhouette_score"] > 0
    assert labelled.count() == 195


def test_permutation_importance_runs(unit_df):
    df = unit_df.drop("rid")
    res = MD.train_supervised(df, "sotib_oldi", algorithm="logistic_regression", cv_folds=0)
    imp = X.permutation_importance(res, df, sample_size=100, repeats=2).collect()
    assert {r["feature"] for r in imp} == {"yosh", "daromad", "shahar"}


def test_permutation_importance_scores_all_rows(spark, monkeypatch):
    """Every row is scored for each (feature, repeat); its values are a permutation, of equal rows too."""
    df = spark.range(1500).select(F.when(F.col("id") < 500, 7.0).otherwise(F.col("id") * 1.0).alias("x"),
                                  F.when(F.col("id") < 500, 0.0).otherwise(F.col("id") % 13 * 1.0).alias("z"),
                                  (F.col("id") > 900).cast("int").alias("y"))
    res = MD.train_supervised(df, "y", algorithm="logistic_regression", cv_folds=0)
    seen, score = {}, X._score
    monkeypatch.setattr(X, "_score", lambda pred, *a: (seen.update(pred=pred), score(pred, *a))[1])
    imp = {r["feature"]: r["importance"] for r in X.permutation_importance(res, df, repeats=3).collect()}
    rows = seen["pred"].select("feature", "rep", "x", "z").collect()
    orig = {c: sorted(r[c] for r in df.collect()) for c in "xz"}
    groups = {}
    for r in rows:
        groups.setdefault((r["feature"], r["rep"]), []).append(r)
    assert len(groups) == 7 and all(len(g) == 1500 for g in groups.values())
    assert all(sorted(r[c] for r in g) == orig[c] for g in groups.values() for c in "xz")
    assert imp["x"] > 0.2 and abs(imp["z"]) < 0.05
